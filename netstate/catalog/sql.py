"""Plain SQL building blocks that state the expected results."""

from __future__ import annotations

from netstate.constants import STATE_CLASSES, STATE_FEATURES, WINDOW_AGGREGATES
from netstate.sources.tables import FLOWS_SQL, PACKETS_SQL, SCORED_SQL

HOUR = 3600

FLOW_COLUMN = {
    " Total Fwd Packets": "tot_fwd_pkts", " Total Backward Packets": "tot_bwd_pkts",
    "Total Length of Fwd Packets": "totlen_fwd_pkts", " Total Length of Bwd Packets": "totlen_bwd_pkts",
    " SYN Flag Count": "syn_flag_cnt", " ACK Flag Count": "ack_flag_cnt", "FIN Flag Count": "fin_flag_cnt",
    " RST Flag Count": "rst_flag_cnt", " PSH Flag Count": "psh_flag_cnt", " URG Flag Count": "urg_flag_cnt",
    " Flow IAT Mean": "flow_iat_mean", " Flow IAT Min": "flow_iat_min", " Flow IAT Max": "flow_iat_max",
    " Flow Duration": "flow_duration", " Average Packet Size": "pkt_size_avg", " Max Packet Length": "pkt_len_max",
}
SQL_AGGREGATE = {"sum": "sum", "mean": "avg", "var": "var_samp", "min": "min", "max": "max"}

FLOWS = "flows AS (" + FLOWS_SQL.format(events="events") + ")"
PACKETS = "packets AS (" + PACKETS_SQL.format(lineitem="lineitem") + ")"
SCORED = "scored AS (" + SCORED_SQL.format(flows="flows") + ")"

TRAINING_STATE = """CASE WHEN l = 'benign' THEN 'BENIGN' WHEN contains(l, 'ddos') THEN 'DDoS'
  WHEN starts_with(l, 'dos ') OR l = 'dos' THEN 'DoS'
  WHEN contains(l, 'portscan') OR contains(l, 'port scan') THEN 'PortScan' END"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _features(seconds: int, finite: str = "{c}") -> str:
    parts = ["CAST(count(*) AS DOUBLE) AS flow_count"]
    for role in ("src_ip", "dst_ip", "src_port", "dst_port"):
        parts.append(f"CAST(count(DISTINCT {role}) AS DOUBLE) AS unique_{role}_count")
    for output, feature, how in WINDOW_AGGREGATES:
        column = finite.format(c=FLOW_COLUMN[feature])
        parts.append(f"coalesce({SQL_AGGREGATE[how]}({column}), 0) AS {output}")
    for c in STATE_CLASSES:
        parts.append(f"count(*) FILTER (WHERE state = '{c}') AS {c.lower()}_flow_count")
    return ",\n  ".join(parts)


def _derived(seconds: int) -> str:
    b, d, o, p = (f"{c.lower()}_flow_count" for c in STATE_CLASSES)
    return f"""*, total_fwd_packets + total_bwd_packets AS total_packets, total_fwd_bytes + total_bwd_bytes AS total_bytes,
  (total_fwd_packets + total_bwd_packets) / {seconds} AS packets_per_second,
  (total_fwd_bytes + total_bwd_bytes) / {seconds} AS bytes_per_second, flow_count / {seconds} AS flows_per_second,
  {b} + {d} + {o} + {p} AS scoreable_flow_count,
  CASE greatest({b}, {d}, {o}, {p}) WHEN {b} THEN 'BENIGN' WHEN {d} THEN 'DDoS' WHEN {o} THEN 'DoS' ELSE 'PortScan' END AS dominant_state,
  CAST({d} + {o} + {p} > 0 AS INT) AS attack_present,
  CASE WHEN {d} + {o} + {p} = 0 THEN 'NONE' ELSE CASE greatest({d}, {o}, {p}) WHEN {d} THEN 'DDoS' WHEN {o} THEN 'DoS' ELSE 'PortScan' END END AS alert_state"""


def states(seconds: int = HOUR, where: str = "TRUE", name: str = "states") -> str:
    """Time-window states of `flows`."""
    return f"""_t0 AS (SELECT session_id, min(epoch_us(timestamp)) AS t0 FROM flows GROUP BY 1),
_w AS (SELECT f.*, current_state AS state, t0, (epoch_us(timestamp) - t0) // {seconds * 1000000} AS window_id FROM flows f JOIN _t0 USING (session_id)),
_a AS (SELECT session_id, window_id, min(t0) + window_id * {seconds * 1000000} AS start_us,
  {_features(seconds)} FROM _w GROUP BY 1, 2),
{name} AS (SELECT {_derived(seconds)} FROM _a WHERE benign_flow_count + ddos_flow_count + dos_flow_count + portscan_flow_count > 0 AND {where})"""


def proxy_states(rows: int = 10) -> str:
    """Row-order windows of `flows` with ground-truth labels."""
    return f"""_l AS (SELECT *, lower(trim(label)) AS l, row_number() OVER (PARTITION BY session_id ORDER BY flow_seq) - 1 AS rn FROM flows),
_w AS (SELECT *, coalesce({TRAINING_STATE}, 'INVALID_FEATURES') AS state, rn // {rows} AS window_id FROM _l),
_a AS (SELECT session_id, window_id, {_features(rows, "CASE WHEN isfinite({c}) THEN {c} END")} FROM _w GROUP BY 1, 2),
proxy AS (SELECT {_derived(rows)} FROM _a WHERE benign_flow_count + ddos_flow_count + dos_flow_count + portscan_flow_count > 0)"""


def rounded_features(places: int = 6) -> str:
    return ", ".join(f"round({f}, {places}) AS {f}" for f in STATE_FEATURES)
