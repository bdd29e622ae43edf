"""NULL keys, NULL cells, several sessions, foreign headers, dates, pages and allocations."""

from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from netstate import scale
from netstate.functions.timestamps import parse_text
from netstate.operators import modeling as ml
from netstate.operators import packets as pk
from netstate.operators import profile, signatures, splits
from netstate.operators.transitions import chronological_position
from netstate.sources import flow_files as ff
from tests.test_sources import write

KEYED = [(None, 3, 1), (None, 900, 2), ("a", 5, 3), ("a", 6, None), (None, None, 5), ("a", None, 6), ("b", 70_000, 7)]


def test_null_keys_and_orders_keep_their_rows(spark):
    df = spark.createDataFrame(KEYED, "k string, o long, v long")
    window = Window.partitionBy("k").orderBy("o")
    got = scale.with_position(df, ["k"], "o", bits=2, position="p").collect()
    assert sorted(got, key=repr) == sorted(df.withColumn("p", F.row_number().over(window).cast("long")).collect(), key=repr)
    got = scale.with_previous(df, ["k"], "o", ["v"], bits=2).collect()
    assert sorted(got, key=repr) == sorted(df.withColumn("prev_v", F.lag("v").over(window)).collect(), key=repr)
    got = scale.with_next(df, ["k"], "o", ["v"], bits=2).collect()
    assert sorted(got, key=repr) == sorted(df.withColumn("next_v", F.lead("v").over(window)).collect(), key=repr)
    got = scale.with_running_total(df, ["k"], "o", "v", "t", bits=2).collect()
    total = F.coalesce(F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    assert sorted(got, key=repr) == sorted(df.withColumn("t", total).collect(), key=repr)


def test_row_hash_knows_where_null_stands(spark):
    df = spark.createDataFrame([("s", "a", None), ("s", None, "a"), ("s", None, None), ("s", "a", None)], "session_id string, x string, y string")
    assert profile.duplicate_rows(df, ["x", "y"]).first()["duplicate_rows"] == 1
    assert profile.source_profile(df, order=None).first()["duplicate_rows"] == 1


def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", ["x,y,Label", "1,2,BENIGN"])
    write(tmp_path / "b.csv", ["y,Label,x", "20,DoS,10", "21,DoS,11"])
    rows = ff.read_flow_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]).orderBy("flow_seq").collect()
    assert [(r["session_id"], r["x"], r["y"]) for r in rows] == [("b", "10", "20"), ("b", "11", "21"), ("a", "1", "2")]
    good, bad = ff.read_labelled(spark, str(tmp_path / "*.csv"))
    assert sorted((r["x"], r["y"], r["Label"]) for r in good.collect()) == [("1", "2", "BENIGN"), ("10", "20", "DoS"), ("11", "21", "DoS")]
    assert bad.count() == 0
    with pytest.raises(FileNotFoundError):
        ff.read_flow_csv(spark, str(tmp_path / "none*.csv"))


def test_source_order_over_several_sessions(spark):
    rows = [("m", 0, i, "x") for i in range(4)] + [("t", 1, i, "x") for i in range(4)] + [("t", 1, 9, None)]
    df = spark.createDataFrame(rows, "session_id string, session_rank int, flow_seq long, label string")
    first = splits.first_per_class(df, 2, "label", "flow_seq", bits=1, sessions=["session_rank"]).collect()
    assert sorted((r["session_id"], r["flow_seq"], r["label"]) for r in first if r["label"]) == [("m", 0, "x"), ("m", 1, "x")]
    assert sum(r["label"] is None for r in first) == 1
    cut = splits.split_within_class(df, "label", "flow_seq", 0.5, bits=1, sessions=["session_rank"])
    assert {(r["session_id"], r["split"]) for r in cut.where("label = 'x'").collect()} == {("m", "train"), ("t", "validation")}
    contacts = spark.createDataFrame([("k", s, i, 10 + 4 * s + i) for s in (0, 1) for i in range(4)], "k string, r int, o long, port long")
    assert signatures.port_walks(contacts, ["k"], "o", bits=1, sessions=["r"]).first()["pattern"] == "sequential"


def test_stable_chronological_order(spark):
    rows = [("s", datetime(2026, 1, 1, 0, 0, t), i) for i, t in enumerate([5, 1, 5, 0, 1])]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, row long")
    got = {r["row"]: r["place"] for r in chronological_position(df, "ts", "row").collect()}
    assert got == {3: 1, 1: 2, 4: 3, 0: 4, 2: 5}


@pytest.mark.parametrize(
    "text, expected, day_first",
    [
        ("3/7/2017 8:55", "2017-03-07 08:55:00", "2017-07-03 08:55:00"), ("12/25/2017 08:00", "2017-12-25 08:00:00", None),
        ("25/12/2017 08:00:01", "2017-12-25 08:00:01", None), ("3/7/2017 8:55:01 PM", "2017-03-07 20:55:01", "2017-07-03 20:55:01"),
        ("2017-07-03 08:55:58", "2017-07-03 08:55:58", None), ("2017/07/03 08:55", "2017-07-03 08:55:00", None),
        ("2026-01-01T00:00:00+02:00", "2025-12-31 22:00:00", None), ("not-a-date", None, None), ("99/99/2017", None, None),
    ],
)
def test_dates_put_the_month_first_unless_impossible(spark, text, expected, day_first):
    df = spark.createDataFrame([(text,)], "t string")
    shown = lambda first: df.select(F.date_format(parse_text(F.col("t"), first), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert shown(False) == expected and shown(True) == (day_first or expected)


def test_pages_have_no_hidden_limit(spark):
    packets = spark.range(60_000).select(F.col("id").alias("packet_no"))
    assert pk.packet_page(packets, 60_000).count() == 60_000
    assert pk.packet_range(packets, 60_000, -1).count() == 60_000
    assert [r[0] for r in pk.packet_page(packets, 3, 50_000).orderBy("packet_no").collect()] == [50_000, 50_001, 50_002]
    with pytest.raises(ValueError):
        pk.packet_page(packets, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=12), st.integers(1, 150))
def test_allocation_gives_the_wanted_rows(counts, size):
    named = {f"c{i:02d}": n for i, n in enumerate(counts)}
    share = ml.sample_allocation(named, size)
    target = min(size, sum(counts))
    assert sum(share.values()) == target and all(0 <= share[c] for c in named)
    if len(counts) <= target:
        assert min(share.values()) >= 1


def test_more_classes_than_samples(spark):
    rows = spark.range(200).select("id", F.format_string("c%03d", F.col("id") % 40).alias("c"))
    assert ml.stratified_sample(rows, "c", "id", size=10).count() == 10
    assert ml.stratified_sample(rows.limit(0), "c", "id", size=10).count() == 0


def test_linear_model_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(5, 3)), rng.normal(size=(4, 3)), rng.normal(size=4)
    model = ml.LinearModel(tuple(map(tuple, w.tolist())), tuple(b.tolist()))
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "i int, x array<double>").withColumn("features", array_to_vector("x"))
    out = ml.with_probabilities(model.transform(df)).orderBy("i").collect()
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.allclose([[r[c] for c in ml.PROBABILITIES] for r in out], p)
    assert model.numFeatures == 3 and np.allclose(model.coefficientMatrix.toArray(), w)


def test_late_windows_are_reported(spark, tmp_path):
    from netstate.streaming import flows as stream
    from tests.helpers import windows

    path = str(tmp_path / "states")
    windows(spark, [5, 6, 8]).coalesce(1).write.parquet(path)
    schema = spark.read.parquet(path).schema
    live = stream.transition_stream(spark.readStream.schema(schema).parquet(path))
    stream.write_available(live, str(tmp_path / "out"), str(tmp_path / "check"))
    windows(spark, [7, 9]).coalesce(1).write.mode("append").parquet(path)
    stream.write_available(live, str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted((r["late"], r["current_window"], r["next_window"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(False, 5, 6), (False, 6, 8), (False, 8, 9), (True, 7, None)]


def test_ranking_does_not_depend_on_buckets(spark):
    from netstate.operators.metrics import ranking_metrics

    rng = np.random.default_rng(3)
    rows = [(["BENIGN", "DDoS", "DoS", "PortScan"][i], *map(float, p)) for i, p in zip(rng.integers(0, 4, 300), rng.integers(0, 40, (300, 4)) / 40)]
    df = spark.createDataFrame(rows, "y_true string, p_benign double, p_ddos double, p_dos double, p_portscan double")
    one, many = (sorted(ranking_metrics(df, bucket_rows=n).collect()) for n in (1000, 6))
    assert [r["class"] for r in one] == [r["class"] for r in many]
    assert np.allclose([tuple(r)[1:] for r in one], [tuple(r)[1:] for r in many])
