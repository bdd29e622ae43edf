import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from netstate.catalog import _areas
from tests.helpers import SMALL
from tools.check_queries import compare

SAMPLE = [
    "window_state_vectors", "proxy_state_vectors", "state_transitions", "multistep_sequences", "rolling_folds", "signature_states",
    "packet_features", "ranking_metrics", "source_profile", "leakage_found", "attack_candidates", "stream_transitions",
]


def test_names_are_unique_and_statements_have_queries():
    queries, sql = entry.queries(), entry.oracle_sql()
    own = [name for area in _areas() for name in area.QUERIES]
    assert len(own) == len(set(own)) and set(own) <= set(queries)
    assert set(sql) <= set(queries) and len(sql) > 100


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert compare(got, db.sql(entry.oracle_sql()[name]).df()).startswith("ok")
