"""Flows with all features against a plain computation, and streams that arrive out of order against the batch operators."""

import uuid
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from netstate.constants import FLOW_FEATURES
from netstate.operators import flow_features as ff
from netstate.operators.states import window_states
from netstate.operators.transitions import transitions
from netstate.sources.tables import derive_flows, derive_trace
from netstate.streaming import assembly
from netstate.streaming.flows import write_available
from tests.helpers import SMALL

IDS = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "segment", "part", "start_us"]
SCHEMA = (
    "packet_no long, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, payload_len int, "
    "header_len int, tcp_window int, fin boolean, syn boolean, rst boolean, psh boolean, ack boolean, urg boolean, cwr boolean, ece boolean"
)
START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def packet(no, seconds, side="a", size=100, **values):
    ends = [("10.0.0.1", 1000), ("10.0.0.2", 80)]
    (src, sport), (dst, dport) = ends if side == "a" else ends[::-1]
    flags = {f: values.get(f, False) for f in ff.FLAGS}
    order = ["fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece"]
    return (no, START + timedelta(seconds=seconds), src, sport, dst, dport, "TCP", size, 20, values.get("window", 500), *[flags[f] for f in order])


def rows(spark, packets):
    return spark.createDataFrame(packets, SCHEMA)


def plain(frame, idle, active):
    """Every flow of a table of packets, by a loop over its conversations."""
    table = frame.withColumn("us", F.unix_micros("ts")).toPandas().sort_values(["us", "packet_no"])
    keys = [tuple(sorted([(str(a), b), (str(c), d)])) + (p,) for a, b, c, d, p in zip(table.src_ip, table.src_port, table.dst_ip, table.dst_port, table.protocol)]
    out = {}
    for key, own in table.assign(key=keys).groupby("key", sort=False):
        us, ends = own.us.to_numpy(), (own.fin | own.rst).to_numpy()
        segment, begun, part, flows = 0, None, None, []
        for i in range(len(us)):
            if i == 0 or us[i] - us[i - 1] > idle * 1e6 or ends[i - 1]:
                segment, begun, part = segment + 1, us[i], None
            now = (us[i] - begun) // (active * 1_000_000)
            if now != part:
                flows.append((segment, now, []))
                part = now
            flows[-1][2].append(i)
        for segment, part, at in flows:
            mine = own.iloc[at]
            forward = ((mine.src_ip == mine.src_ip.iloc[0]) & (mine.src_port == mine.src_port.iloc[0])).to_numpy()
            columns = {n: mine[n].to_numpy() for n in ("payload_len", "header_len", "tcp_window", *ff.FLAGS)}
            out[key, segment, part] = ff.features_of_packets(us[at], forward, columns, float(mine.dst_port.iloc[0]))
    return out


def by_key(found):
    return {
        (tuple(sorted([(str(r["src_ip"]), r["src_port"]), (str(r["dst_ip"]), r["dst_port"])])) + (r["protocol"],), r["segment"], r["part"]): r
        for r in found
    }


def close(got, expected):
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        for f in FLOW_FEATURES:
            assert np.isclose(got[key][f], values[f], rtol=1e-9, atol=1e-6), (key, f, got[key][f], values[f])


@pytest.mark.parametrize("bits", [20, 26])
def test_features_equal_a_loop_over_conversations(spark, bits):
    """Buckets of a second cut nearly every flow, period and bulk."""
    trace = derive_trace(spark, SMALL)
    got = [r.asDict() for r in ff.flow_features(trace, 120, 60, bits=bits).collect()]
    close(by_key(got), plain(trace, 120, 60))


def test_flows_end_with_closing_packets_pauses_and_age(spark):
    packets = [packet(1, 0), packet(2, 1, "b", fin=True), packet(3, 2), packet(4, 3, rst=True), packet(5, 200), packet(6, 230), packet(7, 265), packet(8, 500)]
    flows = ff.flow_features(rows(spark, packets), 120, 60).orderBy("segment", "part").collect()
    assert [(r.segment, r.part, r[" Total Fwd Packets"] + r[" Total Backward Packets"]) for r in flows] == [(1, 0, 2), (2, 0, 2), (3, 0, 2), (3, 1, 1), (4, 0, 1)]


def test_islands_of_one_flow(spark):
    """Two bulks forward that a data packet of the other side parts, three packets that are too few, and a period of activity."""
    times = [("a", t / 10) for t in range(4)] + [("b", 0.45)] + [("a", 0.5 + t / 10) for t in range(5)] + [("b", 8 + t / 10) for t in range(3)]
    flow = ff.flow_features(rows(spark, [packet(i, t, side) for i, (side, t) in enumerate(times)])).first()
    assert (flow["Fwd Avg Bytes/Bulk"], flow[" Fwd Avg Packets/Bulk"], flow[" Bwd Avg Packets/Bulk"]) == (450.0, 4.5, 0.0)
    assert round(flow[" Fwd Avg Bulk Rate"], 3) == round(900 / 0.7, 3)
    assert (flow["Active Mean"], flow[" Active Max"], flow["Idle Mean"], flow[" Idle Std"]) == (550_000.0, 900_000.0, 7_100_000.0, 0.0)
    assert flow["Subflow Fwd Packets"] == 4.5


def test_missing_endpoints_times_and_empty_tables(spark):
    packets = [packet(1, 0), (*packet(2, 1)[:2], None, None, *packet(2, 1)[4:]), (3, None, *packet(3, 1)[2:]), (*packet(4, 5)[:2], None, None, *packet(4, 5)[4:])]
    flows = ff.flow_features(rows(spark, packets)).collect()
    assert sorted(r[" Total Fwd Packets"] + r[" Total Backward Packets"] for r in flows) == [1.0, 2.0]
    assert ff.flow_features(rows(spark, [])).count() == 0


def stream_of(spark, tmp_path, frame, files):
    """One file per batch."""
    folder = str(tmp_path / uuid.uuid4().hex)
    for part in files:
        frame.where(part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, tmp_path, stream):
    out = str(tmp_path / uuid.uuid4().hex)
    write_available(stream, f"{out}/rows", f"{out}/checkpoint")
    return [r.asDict() for r in spark.read.parquet(f"{out}/rows").collect()]


def test_stream_in_any_order_within_the_delay_equals_the_batch(spark, tmp_path):
    """Batches of ten seconds; a third of each batch's packets arrive with the next one."""
    trace = derive_trace(spark, SMALL).where("src_port % 4 = 1 OR dst_port % 4 = 1").cache()
    micros = F.unix_micros("ts")
    first = trace.agg(F.min(micros)).first()[0]
    number = ((micros - F.lit(first)) / 10_000_000).cast("int") + F.when(F.xxhash64("packet_no") % 3 == 0, 1).otherwise(0)
    files = [number == i for i in range(trace.agg(F.max(number)).first()[0] + 1)]
    live = stream_of(spark, tmp_path, trace, files)
    got = by_key(run(spark, tmp_path, assembly.flow_feature_stream(live, 15, 20, "25 seconds")))
    batch = {k: r for k, r in by_key([r.asDict() for r in ff.flow_features(trace, 15, 20).collect()]).items()}
    mark = trace.agg(F.max(micros)).first()[0] // 1000 * 1000 - 25_000_000
    closed = {
        k: r for k, r in batch.items()
        if (r["ended"] and r["end_us"] < mark) or r["end_us"] + 15_000_000 < mark or r["segment_start"] + (r["part"] + 1) * 20_000_000 <= mark
    }
    assert len(closed) > 20 and len(closed) < len(batch)
    close(got, closed)


def test_late_packets_are_dropped(spark, tmp_path):
    frame = rows(spark, [packet(1, 0), packet(2, 10), packet(3, 1000), packet(4, 5), packet(5, 2000), packet(6, 3000)])
    live = stream_of(spark, tmp_path, frame, ["packet_no <= 2", "packet_no = 3", "packet_no = 5", "packet_no in (4, 6)"])
    got = run(spark, tmp_path, assembly.flow_feature_stream(live, 120, 3600, "60 seconds"))
    assert sorted((r["start_us"] - int(START.timestamp() * 1e6)) // 1_000_000 for r in got) == [0, 1000, 2000]
    assert sorted(r[" Total Fwd Packets"] for r in got) == [1.0, 1.0, 2.0]


def test_transitions_wait_for_windows_that_come_late(spark, tmp_path):
    states = window_states(derive_flows(spark, SMALL), 6 * 3600).where("window_id % 5 <> 3").select(
        "session_id", "window_id", "window_start", "dominant_state", "attack_present"
    ).cache()
    place = F.pmod(F.xxhash64("session_id", "window_id"), F.lit(3))
    number = F.floor(F.unix_micros("window_start") / F.lit(2 * 86400 * 10**6)) + place
    low, high = states.agg(F.min(number), F.max(number)).first()
    live = stream_of(spark, tmp_path, states, [number == i for i in range(low, high + 1)])
    got = run(spark, tmp_path, assembly.ordered_transition_stream(live, "7 days", 365 * 86400))
    mark = states.agg(F.max(F.unix_micros("window_start"))).first()[0] // 1000 * 1000 - 7 * 86400 * 10**6
    starts = {(r.session_id, r.window_id): r.us for r in states.withColumn("us", F.unix_micros("window_start")).collect()}
    expected = {
        (r.session_id, r.current_window, r.next_window, r.current_state, r.next_state, r.time_delta_seconds)
        for r in transitions(states.withColumn("window_end", F.col("window_start"))).collect() if starts[r.session_id, r.next_window] < mark
    }
    assert len(expected) > 10
    assert {(r["session_id"], r["current_window"], r["next_window"], r["current_state"], r["next_state"], r["time_delta_seconds"]) for r in got} == expected


def test_idle_sessions_leave_no_state(spark, tmp_path):
    def window(i, hours):
        return ("s", i, START + timedelta(hours=hours), "BENIGN", 0)

    frame = spark.createDataFrame(
        [window(0, 0), window(1, 1), window(2, 100), window(3, 101), ("t", 9, START + timedelta(hours=50), "DoS", 1), ("t", 10, START + timedelta(hours=300), "DoS", 1)],
        "session_id string, window_id long, window_start timestamp, dominant_state string, attack_present int",
    )
    live = stream_of(spark, tmp_path, frame, ["window_id <= 1", "window_id = 9", "window_id in (2, 3)", "window_id = 10"])
    got = run(spark, tmp_path, assembly.ordered_transition_stream(live, "1 hour", 24 * 3600))
    assert sorted((r["current_window"], r["next_window"]) for r in got) == [(0, 1), (2, 3)]
