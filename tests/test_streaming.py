from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from tests.helpers import START, flow, flows, windows
from tests.test_signatures import packet, packets

from netstate.operators import signatures as sig
from netstate.operators.packets import assemble_flows
from netstate.operators.states import window_states
from netstate.operators.transitions import transitions
from netstate.streaming import flows as stream


def run(df_stream, tmp_path, name):
    out, check = str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")
    stream.write_available(df_stream, out, check)
    return df_stream.sparkSession.read.parquet(out)


def source(spark, table, tmp_path, name):
    path = str(tmp_path / name)
    table.coalesce(1).write.parquet(path)
    return spark.readStream.schema(table.schema).parquet(path)


def closing(i, when, **values):
    """A far later row that moves the watermark past everything else."""
    return flow(i, timestamp=START + timedelta(seconds=when), session_id="z", dst_ip="z", **values)


def test_state_stream_equals_batch(spark, tmp_path):
    states = ["BENIGN", "DDoS", "DoS", "BENIGN", "INVALID_FEATURES"]
    rows = [flow(i, session_id="ab"[i % 2], timestamp=START + timedelta(seconds=3 * (i // 2)), current_state=states[i % 5]) for i in range(60)]
    table = flows(spark, rows)
    live = source(spark, flows(spark, rows + [closing(99, 9999)]), tmp_path, "flows")
    got = run(stream.state_stream(live, 10), tmp_path, "states").where("session_id <> 'z'")
    columns = ["session_id", "window_start", "flow_count", "total_packets", "mean_iat", "dominant_state", "alert_state", "unique_src_ip_count"]
    want = window_states(table, 10)
    as_rows = lambda df: sorted(df.select(*[F.col(c).cast("string") if c == "window_start" else F.col(c) for c in columns]).collect())
    assert [tuple(map(str, r)) for r in as_rows(got.withColumn("flow_count", F.col("flow_count") * 1.0).withColumn("unique_src_ip_count", F.col("unique_src_ip_count") * 1.0))] == [
        tuple(map(str, r)) for r in as_rows(want)]


def test_flood_alerts_equal_batch(spark, tmp_path):
    rows = [flow(i, timestamp=START, src_ip=f"10.0.1.{i}", dst_ip="v" if i % 2 else "w", tot_fwd_pkts=50.0) for i in range(60)]
    rows += [flow(100 + i, timestamp=START + timedelta(seconds=5), src_ip="one", dst_ip="u", tot_fwd_pkts=30.0, syn_flag_cnt=5.0) for i in range(10)]
    live = source(spark, flows(spark, rows + [closing(999, 9999)]), tmp_path, "flows")
    batch = sig.flood_evidence(flows(spark, rows)).where("state is not null")
    got = run(stream.flood_alert_stream(live), tmp_path, "ddos").collect()
    assert sorted((r["victim"], r["unique_sources"], r["victim_flow_ratio"]) for r in got) == sorted(
        (r["victim"], r["unique_sources"], r["victim_flow_ratio"]) for r in batch.where("state = 'DDoS'").collect())
    assert len(got) == 2
    single = run(stream.single_source_alert_stream(live), tmp_path, "dos").collect()
    assert [(r["victim"], r["flow_count"]) for r in single] == [("u", 10)]
    with pytest.raises(ValueError):
        stream.flood_alert_stream(live, min_victim_share=0.3)


def test_transition_stream_keeps_state_across_batches(spark, tmp_path):
    table = windows(spark, [0, 1, 4, 5, 6], session="a", states=["BENIGN", "DoS", "DoS", "BENIGN", "DDoS"]).unionByName(windows(spark, [3, 9], session="b"))
    path = str(tmp_path / "in")
    for i, part in enumerate((table.where("window_id < 5"), table.where("window_id >= 5"))):
        part.coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(stream.transition_stream(live), tmp_path, "moves")
    want = transitions(table)
    columns = ["session_id", "current_window", "next_window", "current_state", "next_state", "time_delta_seconds"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_flow_stream_equals_batch(spark, tmp_path):
    rows = [packet(1, 0, "a", 1, "b", 2, size=4), packet(2, 10, "b", 2, "a", 1, size=6), packet(3, 500, "a", 1, "b", 2), packet(4, 99999, "z", 1, "y", 1)]
    live = source(spark, packets(spark, rows), tmp_path, "p")
    got = run(stream.flow_stream(live), tmp_path, "f").where("ip_a = 'a'").orderBy("first_packet").collect()
    want = assemble_flows(packets(spark, rows[:3])).orderBy("flow_no").collect()
    assert [(r["packets"], r["bytes"], r["flow_duration"]) for r in got] == [
        (r["tot_fwd_pkts"] + r["tot_bwd_pkts"], r["totlen_fwd_pkts"] + r["totlen_bwd_pkts"], r["flow_duration"]) for r in want]


def test_rates_duplicates_and_files(spark, tmp_path):
    rows = [packet(i, i * 0.5, "a", 1, "b", 2) for i in range(40)] + [packet(99, 9999, "a", 1, "b", 2)]
    live = source(spark, packets(spark, rows), tmp_path, "p")
    rates = run(stream.packet_rate_stream(live), tmp_path, "r")
    assert rates.agg(F.max("packets_per_second")).first()[0] == 2.0
    table = flows(spark, [flow(0), flow(0), flow(1), closing(9, 9999)])
    seen = run(stream.deduplicated(source(spark, table, tmp_path, "d"), ["flow_seq"]), tmp_path, "u")
    assert seen.count() == 3
    path = tmp_path / "csv"
    path.mkdir()
    (path / "monday.csv").write_text("x,y\n1,2\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())])
    files = run(stream.flow_file_stream(spark, str(path), schema, "csv"), tmp_path, "m").collect()
    assert [(r["session_id"], r["x"]) for r in files] == [("monday", "1")]


def test_scored_stream(spark, tmp_path):
    from netstate.operators import modeling as ml
    from netstate.operators import splits

    rows = spark.sql("SELECT id, if(id % 2 = 0, 'BENIGN', 'DDoS') AS s, id % 2 * 1.0D AS x FROM range(20)")
    scaler = splits.fit_min_max(rows, ["x"])
    vectors = ml.to_vectors(rows, ["x"], "s", scaler).select("id", "features", "label")
    model = ml.fit_logistic(vectors.select("features", "label"), 10)
    live = source(spark, vectors, tmp_path, "v")
    out = str(tmp_path / "scored")
    query = stream.scored_stream(live, model, lambda df, _: df.select("id", "prediction").write.mode("append").parquet(out), str(tmp_path / "c"))
    query.awaitTermination()
    assert spark.read.parquet(out).where("prediction = id % 2").count() == 20
