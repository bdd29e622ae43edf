"""Small flow, window and prediction tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from netstate.constants import STATE_FEATURES

SMALL = "/root/testdata/sf0.001"
START = datetime(2026, 1, 1, 0, 0, 0)

FLOW_SCHEMA = (
    "flow_seq long, session_id string, timestamp timestamp, src_ip string, dst_ip string, src_port int, dst_port int, "
    "tot_fwd_pkts double, tot_bwd_pkts double, totlen_fwd_pkts double, totlen_bwd_pkts double, flow_pkts_s double, "
    "syn_flag_cnt double, ack_flag_cnt double, fin_flag_cnt double, rst_flag_cnt double, psh_flag_cnt double, "
    "urg_flag_cnt double, flow_iat_mean double, flow_iat_min double, flow_iat_max double, flow_duration double, "
    "pkt_size_avg double, pkt_len_max double, current_state string"
)


def flow(i, **values):
    row = {
        "flow_seq": i, "session_id": "a", "timestamp": START + timedelta(seconds=2 * i), "src_ip": f"10.0.0.{i % 5}",
        "dst_ip": f"192.168.0.{i % 3}", "src_port": 40000 + i, "dst_port": 80, "tot_fwd_pkts": 1.0, "tot_bwd_pkts": 2.0,
        "totlen_fwd_pkts": 10.0, "totlen_bwd_pkts": 20.0, "flow_pkts_s": 5.0, "syn_flag_cnt": 0.0, "ack_flag_cnt": 0.0,
        "fin_flag_cnt": 0.0, "rst_flag_cnt": 0.0, "psh_flag_cnt": 0.0, "urg_flag_cnt": 0.0, "flow_iat_mean": float(i),
        "flow_iat_min": 1.0, "flow_iat_max": 9.0, "flow_duration": 100.0, "pkt_size_avg": 50.0, "pkt_len_max": 60.0,
        "current_state": "BENIGN",
    }
    row.update(values)
    return row


def flows(spark, rows):
    names = [part.strip().split(" ")[0] for part in FLOW_SCHEMA.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FLOW_SCHEMA)


def windows(spark, ids, session="s", states=None, seconds=10):
    """Window states whose features are window id + feature index."""
    rows = []
    for i, w in enumerate(ids):
        state = states[i] if states else "BENIGN"
        start = START + timedelta(seconds=seconds * w)
        rows.append(
            (session, w, start, start + timedelta(seconds=seconds), *[float(w + j) for j in range(len(STATE_FEATURES))],
             state, int(state != "BENIGN"), "NONE" if state == "BENIGN" else state)
        )
    schema = "session_id string, window_id long, window_start timestamp, window_end timestamp, " + ", ".join(
        f"{f} double" for f in STATE_FEATURES
    ) + ", dominant_state string, attack_present int, alert_state string"
    return spark.createDataFrame(rows, schema)


def predictions(spark, rows):
    return spark.createDataFrame(
        rows, "y_true string, y_pred string, p_benign double, p_ddos double, p_dos double, p_portscan double, current_state string"
    )
