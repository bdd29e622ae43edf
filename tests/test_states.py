from datetime import timedelta

import pytest
from tests.helpers import START, flow, flows, windows
from pyspark.sql import functions as F

from netstate.constants import FLOW_FEATURES
from netstate.functions.columns import align_features, find_id_columns, match_features
from netstate.functions.labels import evaluation_state, training_state
from netstate.functions.timestamps import parse_timestamps
from netstate.operators.states import proxy_windows, window_states
from netstate.operators.transitions import attack_runs, contiguous_blocks, transitions, window_audit


def test_sums_rates_and_bounds(spark):
    rows = [flow(i, tot_fwd_pkts=20.0) for i in range(5)]
    out = window_states(flows(spark, rows), 10).collect()
    assert len(out) == 1
    assert out[0]["total_fwd_packets"] == 100.0
    assert out[0]["flow_count"] == 5.0
    assert out[0]["flows_per_second"] == 0.5
    assert out[0]["unique_src_ip_count"] == 5.0 and out[0]["unique_dst_ip_count"] == 3.0
    assert out[0]["iat_variance"] == pytest.approx(2.5)
    assert out[0]["window_start"] == START and out[0]["window_end"] == START + timedelta(seconds=10)


def test_boundary_flow_opens_the_next_window(spark):
    rows = [flow(0), flow(1, timestamp=START + timedelta(seconds=10)), flow(2, timestamp=START + timedelta(seconds=35))]
    assert sorted(r["window_id"] for r in window_states(flows(spark, rows), 10).collect()) == [0, 1, 3]


def test_single_flow_has_zero_variance_and_missing_values_are_zero(spark):
    out = window_states(flows(spark, [flow(0, flow_iat_min=None)]), 10).first()
    assert out["iat_variance"] == 0.0 and out["min_iat"] == 0.0


def test_dominance_ties_and_hidden_attack(spark):
    states = ["BENIGN", "DDoS", "DoS", "DoS", "DDoS"]
    out = window_states(flows(spark, [flow(i, current_state=s) for i, s in enumerate(states)]), 10).first()
    assert out["dominant_state"] == "DDoS" and out["alert_state"] == "DDoS"
    states = ["BENIGN"] * 4 + ["PortScan"]
    out = window_states(flows(spark, [flow(i, current_state=s) for i, s in enumerate(states)]), 10).first()
    assert (out["dominant_state"], out["attack_present"], out["alert_state"]) == ("BENIGN", 1, "PortScan")


def test_unscoreable_window_is_dropped_but_flows_count(spark):
    rows = [flow(i, current_state="INVALID_FEATURES") for i in range(5)] + [flow(5), flow(6, current_state="INVALID_FEATURES")]
    out = window_states(flows(spark, rows), 10).collect()
    assert [(r["window_id"], r["flow_count"], r["benign_flow_count"]) for r in out] == [(1, 2.0, 1)]


def test_proxy_windows_ignore_infinities_and_do_not_depend_on_chunks(spark):
    rows = [flow(i, flow_iat_max=float("inf") if i == 3 else 9.0) for i in range(25)]
    table = flows(spark, rows)
    small = proxy_windows(table, F.col("current_state"), bits=2).orderBy("window_id").collect()
    large = proxy_windows(table, F.col("current_state")).orderBy("window_id").collect()
    assert small == large
    assert [r["flow_count"] for r in large] == [10.0, 10.0, 5.0]
    assert large[0]["max_iat"] == 9.0 and large[2]["proxy_start_row"] == 20


def test_gaps_transitions_blocks_and_runs(spark):
    table = windows(spark, [0, 1, 2, 5, 6, 9], states=["BENIGN", "DoS", "DoS", "DoS", "DDoS", "BENIGN"])
    moves = transitions(table, bits=1).orderBy("current_window").collect()
    assert [(r["current_window"], r["next_window"], r["time_delta_seconds"]) for r in moves] == [
        (0, 1, 10.0), (1, 2, 10.0), (2, 5, 30.0), (5, 6, 10.0), (6, 9, 30.0)]
    blocks = contiguous_blocks(table, bits=1).orderBy("start_window").collect()
    assert [(r["start_window"], r["end_window"]) for r in blocks] == [(0, 2), (5, 6), (9, 9)]
    runs = attack_runs(table, bits=1).orderBy("start_window").collect()
    assert [(r["state"], r["start_window"], r["windows"], r["proxy_end_seconds"]) for r in runs] == [
        ("DoS", 1, 2, 30), ("DoS", 5, 1, 60), ("DDoS", 6, 1, 70)]


def test_window_audit_counts_gaps_duplicates_and_overlaps(spark):
    table = windows(spark, [0, 1, 4, 4])
    row = window_audit(table, 10).first()
    assert (row["missing_windows"], row["duplicate_window_ids"], row["overlapping_windows"]) == (2, 1, 1)
    assert window_audit(windows(spark, [0, 1]), 20).first()["bad_duration_windows"] == 2


def test_labels(spark):
    raw = [" BENIGN", "DoS Hulk", "DoS \x96 x", "Heartbleed", "DDoS", "PortScan", "Port Scan", "FTP-Patator", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, l string")
    rows = df.select("i", evaluation_state(F.col("l")), training_state(F.col("l"))).orderBy("i").collect()
    assert [r[1] for r in rows] == ["BENIGN", "DoS", "DoS", "DoS", "DDoS", "PortScan", None, None, None]
    assert [r[2] for r in rows] == ["BENIGN", "DoS", "DoS", None, "DDoS", "PortScan", "PortScan", None, None]


def test_columns_match_by_meaning(spark):
    short = ["Tot Fwd Pkts", "totlen_fwd_pkts", "Flow Byts/s", "CWR Flag Count", "Dst Port"]
    wanted = [" Total Fwd Packets", "Total Length of Fwd Packets", "Flow Bytes/s", " CWE Flag Count", " Destination Port"]
    assert list(match_features(short, wanted).values()) == short
    with pytest.raises(ValueError, match="Idle Min"):
        match_features(short)
    assert find_id_columns(["Src IP", "Flow ID", "Timestamp"]) == {"src_ip": "Src IP", "flow_id": "Flow ID", "timestamp": "Timestamp"}
    df = spark.createDataFrame([tuple("Infinity" if i == 2 else str(i) for i in range(77))], [f.strip() for f in FLOW_FEATURES])
    row = align_features(df).first()
    assert row[2] is None and row[3] == 3.0 and len(row) == 77


def test_timestamps_mixed_bad_and_epoch(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:05",), ("",), ("not-a-date",), (None,), ("03/07/2017 8:55",)], "t string")
    out = [r["timestamp_parsed"] for r in parse_timestamps(df, "t").collect()]
    assert sum(v is not None for v in out) == 2
    seconds = parse_timestamps(spark.createDataFrame([("1700000000",), ("1700000010",)], "t string"), "t")
    millis = parse_timestamps(spark.createDataFrame([(1700000000000,), (1700000010000,)], "t long"), "t")
    assert seconds.select(F.max("timestamp_parsed")).first() == millis.select(F.max("timestamp_parsed")).first()


def test_windows_hold_their_flows(spark):
    from netstate.operators.states import assign_windows

    rows = [flow(i, timestamp=START + timedelta(seconds=i * 7.3), session_id="ab"[i % 2]) for i in range(40)]
    out = assign_windows(flows(spark, rows), 10)
    assert out.where("timestamp < window_start or timestamp >= window_end").count() == 0
    assert out.count() == 40
