from datetime import timedelta

import pytest
from tests.helpers import START, flow, flows
from pyspark.sql import functions as F

from netstate.functions.labels import effective_state
from netstate.functions.values import capture_log_counts, flow_value_panel, safe_file_name
from netstate.operators import packets as pk
from netstate.operators import signatures as sig


def states(table, **rules):
    return [r["signature_state"] for r in sig.signature_states(table, **rules).orderBy("flow_seq").collect()]


def test_fan_in_flood(spark):
    rows = [flow(i, timestamp=START, src_ip=f"10.0.1.{i}", dst_ip="192.168.1.5", tot_fwd_pkts=5.0) for i in range(60)]
    table = flows(spark, rows)
    assert set(states(table)) == {"DDoS"}
    evidence = sig.flood_evidence(table).first()
    assert (evidence["unique_sources"], evidence["victim_flow_ratio"], evidence["state"]) == (60, 1.0, "DDoS")
    assert sig.attack_class(sig.signature_states(table)).first()[0] == "DDoS"
    assert sig.signature_hits(table).first()["detail"] == "60 concurrent sources -> 192.168.1.5 at 420 observed packets/s"


def test_fan_in_over_time_is_no_flood(spark):
    rows = [flow(i, timestamp=START + timedelta(seconds=2 * i), src_ip=f"10.0.1.{i}", dst_ip="v", tot_fwd_pkts=500.0) for i in range(40)]
    assert "DDoS" not in states(flows(spark, rows))


def test_single_source_flood(spark):
    rows = [flow(i, timestamp=START, src_ip="10.9.9.9", dst_ip="v", tot_fwd_pkts=30.0, syn_flag_cnt=5.0, dst_port=80) for i in range(10)]
    assert set(states(flows(spark, rows))) == {"DoS"}


def test_syn_flood_and_missing_columns(spark):
    rows = [flow(0, syn_flag_cnt=40.0, ack_flag_cnt=2.0, flow_pkts_s=500.0), flow(1, syn_flag_cnt=40.0, ack_flag_cnt=30.0, flow_pkts_s=500.0)]
    assert states(flows(spark, rows)) == ["DoS", "BENIGN"]
    bare = spark.createDataFrame([(1, 2.0)], "flow_seq long, other double")
    assert states(bare) == ["BENIGN"]


@pytest.mark.parametrize(
    "ports, pattern",
    [(list(range(1, 51)), "sequential"), ([1, 3, 5, 7, 9], "strided"), ([22, 443, 8080, 53, 21], "randomised"), ([80, 80], "none"),
     ([5, 4, 3, 9, 8], "sequential")],
)
def test_port_walks(spark, ports, pattern):
    table = spark.createDataFrame([("k", i, p) for i, p in enumerate(ports)], "k string, o long, port long")
    assert sig.port_walks(table, ["k"], "o", bits=2).first()["pattern"] == pattern


def test_port_sweep(spark):
    rows = [flow(i, src_ip="10.0.0.9", dst_ip="10.0.0.1", dst_port=i + 1, totlen_fwd_pkts=40.0) for i in range(50)] + [flow(60)]
    table = flows(spark, rows)
    sweep = sig.port_sweeps(table, bits=3).first()
    assert (sweep["unique_ports"], sweep["pattern"], sweep["flow_count"]) == (50, "sequential", 50)
    assert states(table) == ["PortScan"] * 50 + ["BENIGN"]


def test_effective_state(spark):
    rows = [("BENIGN", "DoS"), ("INVALID_FEATURES", "DDoS"), ("PortScan", "DoS"), ("INVALID_FEATURES", "BENIGN")]
    df = spark.createDataFrame(rows, "m string, s string").select(effective_state(F.col("m"), F.col("s")).alias("e"))
    assert [r["e"] for r in df.collect()] == ["DoS", "DDoS", "PortScan", "INVALID_FEATURES"]


@pytest.mark.parametrize(
    "counts, verdict, own",
    [((335, 0, 13, 0), "SUSPICIOUS — DoS?", 0.0374), ((80, 0, 0, 20), "ATTACK — PortScan", 0.2), ((100, 0, 0, 0), "BENIGN", 0.0),
     ((10, 5, 5, 0), "ATTACK — DDoS", 0.25), ((0, 0, 0, 0), "BENIGN", 0.0)],
)
def test_verdict(spark, counts, verdict, own):
    table = spark.createDataFrame([counts], "b long, d long, o long, p long")
    row = sig.verdict_from_counts(table, dict(zip(["BENIGN", "DDoS", "DoS", "PortScan"], [F.col(c) for c in "bdop"]))).first()
    assert row["verdict"] == verdict and row["attack_class_ratio"] == own and row["dominant_state"] == "BENIGN"


def test_signature_confirms_verdict(spark):
    table = spark.createDataFrame([(335, 0, 13, 0)], "b long, d long, o long, p long")
    counts = dict(zip(["BENIGN", "DDoS", "DoS", "PortScan"], [F.col(c) for c in "bdop"]))
    assert sig.verdict_from_counts(table, counts, "DoS").first()["confidence"] == "high"
    assert sig.verdict_from_counts(table, counts, "DDoS").first()["confidence"] == "low"


def test_flag_mask_and_logs(spark):
    row = flow_value_panel(flows(spark, [flow(0, ack_flag_cnt=1.0, syn_flag_cnt=2.0)])).first()
    assert (row["tcp_flag_bitmask"], row["tcp_flags"]) == ("0x12", ".A..S.")
    logs = [("Packets received/dropped on interface 'Wi-Fi': 1,234/5 (pcap:0)",), ("100 packets received by filter\n3 packets dropped by kernel",), ("x",)]
    out = spark.createDataFrame(logs, "t string").select(*capture_log_counts(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [(1234, 5), (100, 3), (None, None)]
    names = spark.createDataFrame([("../a b/c?d.csv",), ("",), (None,)], "n string").select(safe_file_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["c_d.csv", "upload", "upload"]


def packet(no, second, src, sport, dst, dport, proto="TCP", size=0, seq=0, syn=False):
    return (no, START + timedelta(seconds=second), src, dst, sport, dport, proto, 64, 1000, seq, size, syn, False)


def packets(spark, rows):
    return spark.createDataFrame(
        rows,
        "packet_no long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, ttl int, "
        "tcp_window int, tcp_seq long, payload_len int, syn boolean, is_fragment boolean",
    )


def test_conversation_key_ignores_direction_and_counts_repeats(spark):
    rows = [packet(1, 0, "a", 1, "b", 2, syn=True), packet(2, 1, "b", 2, "a", 1, size=10, seq=5), packet(3, 2, "b", 2, "a", 1, size=10, seq=5),
            packet(4, 3, "a", 1, "b", 2), packet(5, 3, "a", 1, "b", 2)]
    out = pk.packet_features(packets(spark, rows)).collect()
    assert len(out) == 1
    assert (out[0]["packet_count"], out[0]["retransmission_count"], out[0]["payload_len_mean"], out[0]["ttl_std"]) == (5, 1, 4.0, 0.0)
    assert pk.retransmissions(packets(spark, rows)).first()["retransmission_count"] == 1


@pytest.mark.parametrize(
    "ports, pattern",
    [(list(range(10, 30)), "sequential"), (list(range(100, 200, 7)), "strided"), ([i * i * 37 % 60000 + 1 for i in range(1, 30)], "randomised"),
     (list(range(1, 9)), None)],
)
def test_packet_scans(spark, ports, pattern):
    rows = [packet(i, i, "a", 5000, "b", p, syn=True) for i, p in enumerate(ports)] + [packet(900, 900, "a", 5000, "b", ports[0], syn=True)]
    out = pk.packet_scans(packets(spark, rows)).collect()
    assert ([r["pattern"] for r in out] or [None]) == [pattern]


def test_idle_conversation_becomes_two_flows(spark):
    rows = [packet(1, 0, "a", 1, "b", 2, size=4), packet(2, 10, "b", 2, "a", 1, size=6), packet(3, 30, "a", 1, "b", 2, size=2), packet(4, 500, "b", 2, "a", 1)]
    out = pk.assemble_flows(packets(spark, rows), idle_seconds=120).orderBy("flow_no").collect()
    assert [(r["src_ip"], r["tot_fwd_pkts"], r["tot_bwd_pkts"], r["totlen_fwd_pkts"]) for r in out] == [("a", 2, 1, 6), ("b", 1, 0, 0)]
    assert out[0]["flow_iat_mean"] == 15e6 and out[0]["flow_iat_max"] == 20e6 and out[0]["flow_iat_std"] == pytest.approx(7071067.81)


def test_empty_capture_is_rejected(spark):
    with pytest.raises(ValueError):
        pk.require_packets(packets(spark, []))
