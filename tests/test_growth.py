"""Steps whose cost once grew with single tasks, repeated derivations or rows of the state."""

import os
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from tests.helpers import SMALL, flow, flows
from tests.test_assembly import SCHEMA

from netstate.catalog import assembly as queries
from netstate.catalog import models, streams
from netstate.operators import neighbours as nb
from netstate.operators.flow_features import FLAGS, flow_features
from netstate.operators.modeling import LinearModel
from netstate.operators.splits import MinMaxModel
from netstate.plans.label_flows import label_flows
from netstate.scale import deal
from netstate.sources import sinks
from netstate.sources.tables import derive_trace
from netstate.streaming import assembly

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_late_rows_come_from_many_files_in_two_batches(spark, tmp_path, monkeypatch):
    rows = [(i, START + timedelta(hours=i), i % 7, ["view", "error", "signup"][i % 3], 1.5 * (i % 11), f'{{"k": {i % 60}}}') for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "_folder", lambda spark: f"{tmp_path}/out")
    found = {r["kind"]: r["rows"] for r in streams.stream_late_rows(spark, str(tmp_path)).collect()}
    mark = max(i for i in range(400) if i % 10) - 120
    late = [i for i in range(400) if i <= mark]
    rest = [i for i in range(400) if i > mark]
    assert found["late"] == sum(i % 10 == 0 for i in late) + sum(i % 7 == 0 for i in late)
    assert found["duplicate"] == sum(i % 7 == 0 for i in rest)
    assert found["accepted"] == sum(i % 10 != 0 for i in range(400)) + sum(i % 10 == 0 for i in rest)
    assert len([f for f in os.listdir(f"{tmp_path}/out/in") if f.endswith(".parquet")]) > 2
    assert sorted(os.listdir(f"{tmp_path}/out/sorted/mark")) == ["batch=0", "batch=1"]


def test_pairs_of_small_tables_are_compared_by_many_tasks(spark):
    points = spark.range(3000).selectExpr("id", "cast(id % 53 as double) a", "cast(id % 31 as double) b", "'x' AS label")
    index = nb.build_index(points, ["a", "b"], "id", "label", most=3, cell_points=64)
    asked = spark.createDataFrame([(r.key, r.cell, r.x) for r in index.points.limit(50).collect()], "_q long, cell int, x array<double>")
    assert nb._searched(asked, index, 3).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_least_keys_of_equal_points_with_either_zero(spark):
    rows = [(i, "x", [0.0 if i % 2 else -0.0, 1.0]) for i in range(20)] + [(100, "x", [2.0, 1.0])]
    points = spark.createDataFrame(rows, "key long, label string, x array<double>")
    assert sorted(r["key"] for r in nb.first_of_each(points, 3).collect()) == [0, 1, 2, 100]


class _Value:
    def __init__(self):
        self.rows = []

    exists = lambda self: bool(self.rows)
    get = lambda self: iter(self.rows)
    appendList = lambda self, rows: self.rows.extend(rows)
    put = lambda self, rows: setattr(self, "rows", list(rows))
    clear = lambda self: self.rows.clear()


class _Handle:
    def __init__(self):
        self.held, self.run = _Value(), _Value()
        self.getListState = lambda name, schema: self.held
        self.getValueState = lambda name, schema: self.run
        self.registerTimer = lambda at: None


def test_packets_of_a_batch_are_one_value_of_the_state():
    n = 500
    flags = {f: np.arange(n) % 7 == 0 for f in FLAGS}
    batch = pd.DataFrame({
        "us": np.arange(n) * 1000, "packet_no": np.arange(n), "from_a": np.arange(n) % 2 == 0, "payload_len": np.arange(n, dtype=np.int32),
        "header_len": np.full(n, 20, np.int32), "tcp_window": [None if i % 3 else i for i in range(n)], **flags,
    })
    handle, processor = _Handle(), assembly.FlowAssembly(120, 60)
    processor.init(handle)
    processor.handleInputRows(("a", 1, "b", 2, "TCP"), iter([batch]), None)
    assert len(handle.held.rows) == 1
    held = assembly._packets(handle.held.get())
    assert list(held.columns) == assembly.PACKET
    for name in ("us", "packet_no", "from_a", "payload_len", *FLAGS):
        assert held[name].tolist() == batch[name].tolist()
    assert held["tcp_window"].isna().sum() == sum(i % 3 != 0 for i in range(n)) and held["tcp_window"].max() == 498


def test_a_stream_has_few_partitions(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 5 AS k", "timestamp_seconds(id + 10) AS ts")
    rows.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = queries._run(live.withWatermark("ts", "1 second").dropDuplicates(["k", "ts"]))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out.count() == 40
    store = out.inputFiles()[0].split("://")[-1].rsplit("/out/", 1)[0] + "/checkpoint/state/0"
    assert len([p for p in os.listdir(store) if p.isdigit()]) == 2 * spark.sparkContext.defaultParallelism


def test_columns_are_added_after_the_rows_are_placed(spark, tmp_path):
    flows = spark.createDataFrame([(i, "s1" if i % 3 else "s2") for i in range(30)], "flow_seq long, session_id string")
    seen = []

    def shape(own):
        seen.append(own.columns)
        return own.withColumn("wide", F.col("flow_seq") * 2)

    names = {s: {"flow_seq": "Flow ID", "wide": "Wide"} for s in ("s1", "s2")}
    sinks.write_session_csv(flows, str(tmp_path), ["s1", "s2"], "flow_seq", names, shape)
    assert seen == [["flow_seq", "session_id"]] * 2
    read = spark.read.option("header", True).csv(f"{tmp_path}/s1.csv")
    assert sorted((int(r["Flow ID"]), int(r["Wide"])) for r in read.collect()) == [(i, 2 * i) for i in range(30) if i % 3]


def test_fits_get_even_partitions_whatever_the_classes(spark, tmp_path):
    kinds = ["view"] * 17 + ["error", "purchase", "signup"]  # one class has most of the rows
    rows = [(i, START + timedelta(minutes=i), i % 7, kinds[i % 20], 1.5 * (i % 11), f'{{"k": {i % 60}}}') for i in range(4000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    train, validation, scaler = models._flow_vectors(spark, str(tmp_path))
    counts = [r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == spark.sparkContext.defaultParallelism and max(counts) < 1.2 * sum(counts) / len(counts)
    assert train.count() + validation.count() == sum(i % 97 != 0 for i in range(4000)) and len(scaler.minimum) == 77


def test_rows_are_dealt_over_a_bounded_number_of_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    parts = [deal(spark.range(100, numPartitions=1), rows, 3).rdd.getNumPartitions() for rows in (100, -(-60 // cores), 1)]
    assert parts == [cores, 2 * cores, 3 * cores]


def test_flows_are_scored_and_stored_once(spark):
    table = flows(spark, [flow(i, tot_fwd_pkts=float(i), flow_pkts_s=1.0) for i in range(20)])
    features = ["tot_fwd_pkts", "flow_pkts_s", "flow_iat_mean"]
    scaler = MinMaxModel({f: 0.0 for f in features}, {f: 20.0 for f in features}, 1)
    given = LinearModel(((1.0, 0.0, 0.1),) + ((0.0, 0.3, -0.7),) * 3, (-0.5, 0.0, -0.1, -0.2))
    out = label_flows(table, given, scaler, features, drop=["flow_iat_mean"])
    assert "flow_iat_mean" not in out.columns and {"tot_fwd_pkts", "signature_state"} <= set(out.columns)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
    plain = table.select("flow_seq", *features).collect()
    want = {}
    for r in plain:
        x = [r[f] * (1.0 / 20.0) for f in features]
        logits = []
        for row, z in zip(given.coefficients, given.intercepts):
            for a, b in zip(x, row):
                z += a * b
            logits.append(z)
        want[r["flow_seq"]] = ["BENIGN", "DDoS", "DoS", "PortScan"][logits.index(max(logits))]
    assert {r["flow_seq"]: r["current_state"] for r in out.collect()} == want


def test_a_linear_model_adds_from_the_left(spark):
    rows = spark.range(7).select("id", array_to_vector(F.array(F.col("id") / 3, F.lit(0.1), F.col("id") * 1e9)).alias("features"))
    model = LinearModel(((0.3, 0.7, -1e-9), (0.1, -0.2, 3e-10)), (0.1, 0.0))
    scored = model.transform(rows)
    assert "ArrowEvalPython" in scored._jdf.queryExecution().executedPlan().toString()
    for r in scored.collect():
        want = []
        for row, z in zip(model.coefficients, model.intercepts):
            for a, b in zip(r["features"].toArray().tolist(), row):
                z += a * b
            want.append(z)
        assert r["rawPrediction"].toArray().tolist() == want and r["prediction"] == want.index(max(want))


def test_packets_of_flows_are_dealt_twice_and_stored_nowhere(spark):
    """Once with the few columns that all borders of buckets are made of, once with all of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        flows = flow_features(derive_trace(spark, SMALL), 120, 60)
        assert flows.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = flows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert (final.count("FileScan parquet"), final.count("ExistingRDD")) == (2, 0), final


def test_bulks_and_periods_that_cross_many_buckets(spark):
    """Buckets of an eighth of a second and of days give the same flows."""
    one, other = ("10.0.0.1", None), ("10.0.0.2", 80)
    times = [("a", t / 10) for t in range(12)] + [("b", 1.2 + t / 10) for t in range(5)] + [("a", 9 + t / 4) for t in range(7)] + [("a", 80 + t) for t in range(3)]
    rows = [(i, START + timedelta(seconds=t), *(one + other if side == "a" else other + one), "TCP", 10 * (i % 5), 20, 500, *[False] * len(FLAGS)) for i, (side, t) in enumerate(times)]
    packets = spark.createDataFrame(rows, SCHEMA)
    small, large = (sorted(tuple(r) for r in flow_features(packets, 120, 60, bits=bits).collect()) for bits in (17, 40))
    assert [r[:11] for r in small] == [r[:11] for r in large] and [r[6] for r in small] == [0, 1]
    assert np.allclose([r[11:] for r in small], [r[11:] for r in large], rtol=1e-12)
