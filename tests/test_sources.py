import hashlib

import pytest
from pyspark.sql import functions as F
from tests.helpers import flow, flows, windows

from netstate.functions.columns import drop_repeated_headers
from netstate.functions.values import finite_number
from netstate.sources import flow_files as ff
from netstate.sources import sinks


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")


def test_csv_rows_keep_file_order(spark, tmp_path):
    write(tmp_path / "day.one.csv", ["Flow ID, Label", *[f"{i},BENIGN" for i in range(5000)]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = ff.read_flow_csv(spark, str(tmp_path / "day.one.csv")).orderBy("flow_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r["Flow ID"]) for r in rows] == list(range(5000))
    assert len({r["flow_seq"] for r in rows}) == 5000 and rows[0]["session_id"] == "day.one"


def test_sessions_and_missing_file(spark, tmp_path):
    write(tmp_path / "a.csv", ["x,Label", "1,BENIGN"])
    write(tmp_path / "b.csv", ["Label,x,y", "DoS,2,3"])
    out = ff.read_sessions(spark, str(tmp_path), ["a.csv", "b.csv"]).orderBy("session_rank").collect()
    assert [(r["session_id"], r["x"], r["y"]) for r in out] == [("a", "1", None), ("b", "2", "3")]
    with pytest.raises(FileNotFoundError, match="c.csv"):
        ff.read_sessions(spark, str(tmp_path), ["a.csv", "c.csv"])


def test_labelled_glob_separates_malformed_rows(spark, tmp_path):
    write(tmp_path / "a.csv", ["x,Label", "1,BENIGN", "2,DoS,extra", "3,DoS"])
    good, bad = ff.read_labelled(spark, str(tmp_path / "*.csv"))
    assert good.count() == 2 and bad.count() == 1
    write(tmp_path / "b.txt", ["x,y", "1,2"])
    with pytest.raises(ValueError):
        ff.read_labelled(spark, str(tmp_path / "*.txt"))


def test_repeated_headers_and_fingerprints(spark, tmp_path):
    write(tmp_path / "a.csv", ["Protocol,x", "6,1", "Protocol,x", "17,2"])
    assert drop_repeated_headers(ff.read_flow_csv(spark, str(tmp_path / "a.csv"))).count() == 2
    row = ff.fingerprints(spark, str(tmp_path / "a.csv")).first()
    assert row["sha256"] == hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest() and row["name"] == "a.csv"


def test_cache_reuses_finished_entries(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    identity = {"b": 1, "a": [1, 2]}
    assert sinks.cached_table(spark, str(tmp_path), identity, build)[1] is False
    table, hit = sinks.cached_table(spark, str(tmp_path), {"a": [1, 2], "b": 1}, build)
    assert hit and table.count() == 3 and len(calls) == 1
    assert sinks.cached_table(spark, str(tmp_path), identity, build, rebuild=True)[1] is False


def test_tables_by_session_recent_dataset_and_timeline(spark, tmp_path):
    table = windows(spark, range(600), session="a").unionByName(windows(spark, range(3), session="b"))
    sinks.write_by_session(table, str(tmp_path / "w"))
    assert sinks.read_windows(spark, str(tmp_path / "w"), ["b"]).count() == 3
    with pytest.raises(Exception):
        sinks.write_by_session(table, str(tmp_path / "w"))
    windows(spark, range(2)).write.parquet(str(tmp_path / "new"))
    found = sinks.recent_dataset(spark, {str(tmp_path / "w"): 1, str(tmp_path / "new"): 2, str(tmp_path / "gone"): 3})
    assert found == str(tmp_path / "w")
    shown = sinks.timeline(table.where("session_id = 'a'")).collect()
    assert len(shown) == 500 and shown[0]["window_id"] == 100 and shown[-1]["window_id"] == 599 and shown[0]["flow_count"] == 100


def test_labelled_flow_files(spark, tmp_path):
    sinks.write_labelled_flows(flows(spark, [flow(0)]), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["current_state"] == "BENIGN"
    sinks.write_manifest(spark, {"rows": 1}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["rows"] == "1"


def test_numbers_are_parsed_without_a_text_between(spark, tmp_path):
    fields = ["1.5", "Infinity", "-Infinity", "NaN", "inf", "x", "", " 2", "1e3", "a", "7"]
    lines = [f"{i},{v},t{i}" for i, v in enumerate(fields)] + ["11", "12,3.5,t,more"]
    (tmp_path / "a.csv").write_text("\n".join(["id,a,b", *lines]) + "\n")
    texts = ff.read_flow_csv(spark, str(tmp_path / "a.csv"))
    numbers = ff.read_flow_csv(spark, str(tmp_path / "a.csv"), lambda names: [n for n in names if n == "a"])
    assert dict(numbers.dtypes)["a"] == "double"
    kept = ["id", finite_number(F.col("a")).alias("a"), "b", "flow_seq"]
    assert numbers.select(*kept).collect() == texts.select(*kept).collect()


def test_session_csv_shows_numbers_as_their_cast_does(spark, tmp_path):
    values = "0.0D, -0.0D, 1e10D, 1e-5D, 123456.789D, double('inf'), double('nan'), cast(null as double), 1.7976931348623157e308D"
    rows = spark.sql(f"SELECT 's' AS session_id, posexplode(array({values})) AS (n, d)").selectExpr("*", "float(d) AS f", "n * 10000000000 AS l", "n > 1 AS b")
    sinks.write_session_csv(rows, str(tmp_path / "out"), ["s"], "n", {"s": {c: c for c in ("n", "d", "f", "l", "b")}})
    read = spark.read.option("header", True).csv(str(tmp_path / "out" / "s.csv")).collect()
    assert sorted(map(tuple, read)) == sorted(map(tuple, rows.selectExpr(*[f"string({c})" for c in ("n", "d", "f", "l", "b")]).collect()))
