"""Parquet tables and the flow, packet and scored-flow tables derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.constants import FLOW_FEATURES

FLOWS_SQL = """
SELECT event_id AS flow_seq, ts AS timestamp,
  CASE WHEN day(ts) <= 8 THEN 's1' WHEN day(ts) <= 16 THEN 's2' WHEN day(ts) <= 24 THEN 's3' ELSE 's4' END AS session_id,
  concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 251 AS STRING)) AS src_ip,
  CASE WHEN k < 50 THEN '192.168.1.5' ELSE concat('172.16.0.', CAST(k AS STRING)) END AS dst_ip,
  CAST(40000 + event_id % 20000 AS INT) AS src_port, CAST(1000 + k AS INT) AS dst_port,
  CAST(CASE WHEN event_id % 5 = 0 THEN 17 ELSE 6 END AS INT) AS protocol,
  CAST(value * 1000 AS DOUBLE) AS flow_duration,
  CAST(1 + k AS DOUBLE) AS tot_fwd_pkts, CAST(event_id % 50 AS DOUBLE) AS tot_bwd_pkts,
  CAST(floor(value * 5) AS DOUBLE) AS totlen_fwd_pkts, CAST(floor(value * 3) AS DOUBLE) AS totlen_bwd_pkts,
  CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(value * 7 AS DOUBLE) END AS flow_pkts_s,
  CAST(event_id % 40 AS DOUBLE) AS syn_flag_cnt, CAST(event_id % 9 AS DOUBLE) AS ack_flag_cnt,
  CAST(event_id % 2 AS DOUBLE) AS fin_flag_cnt, CAST(event_id % 3 AS DOUBLE) AS rst_flag_cnt,
  CAST(event_id % 7 AS DOUBLE) AS psh_flag_cnt, CAST(0 AS DOUBLE) AS urg_flag_cnt,
  CAST(value AS DOUBLE) AS flow_iat_mean, CAST(value / 4 AS DOUBLE) AS flow_iat_min, CAST(value * 2 AS DOUBLE) AS flow_iat_max,
  CAST(40 + k AS DOUBLE) AS pkt_size_avg, CAST(60 + k * 10 AS DOUBLE) AS pkt_len_max,
  CASE WHEN event_id % 97 = 0 THEN 'INVALID_FEATURES' WHEN event_type = 'error' THEN 'DDoS'
       WHEN event_type = 'purchase' THEN 'DoS' WHEN event_type = 'signup' THEN 'PortScan' ELSE 'BENIGN' END AS current_state,
  CASE WHEN event_id % 89 = 0 THEN 'FTP-Patator' WHEN event_id % 11 = 0 THEN 'BENIGN' WHEN event_type = 'error' THEN 'DDoS'
       WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'DoS Hulk' WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN ' DoS slowloris'
       WHEN event_type = 'purchase' THEN 'Heartbleed' WHEN event_type = 'signup' THEN 'PortScan' ELSE 'BENIGN' END AS label
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) e
"""

PACKETS_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS packet_no, l_shipdate AS ts,
  CASE WHEN l_linenumber % 2 = 1 THEN a_ip ELSE b_ip END AS src_ip, CASE WHEN l_linenumber % 2 = 1 THEN b_ip ELSE a_ip END AS dst_ip,
  CASE WHEN l_linenumber % 2 = 1 THEN a_port ELSE b_port END AS src_port, CASE WHEN l_linenumber % 2 = 1 THEN b_port ELSE a_port END AS dst_port,
  CASE WHEN l_suppkey % 4 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
  CAST(floor(32 + l_quantity) AS INT) AS ttl, CAST(floor(l_extendedprice) AS INT) % 65536 AS tcp_window,
  CAST(l_partkey % 20 AS BIGINT) AS tcp_seq, CAST(round(l_discount * 100) AS INT) AS payload_len,
  l_linenumber = 1 AS syn, l_returnflag = 'R' AND l_quantity < 5 AS is_fragment
FROM (SELECT *, concat('10.1.0.', CAST(l_suppkey % 100 AS STRING)) AS a_ip, CAST(1024 + l_suppkey % 8 AS INT) AS a_port,
             concat('10.2.0.', CAST(l_suppkey % 5 AS STRING)) AS b_ip, CAST(1 + l_partkey % 40 AS INT) AS b_port FROM {lineitem}) x
"""

SCORED_SQL = """
SELECT flow_seq, session_id, y_true, y_pred, w1*1.0E0/t AS p_benign, w2*1.0E0/t AS p_ddos, w3*1.0E0/t AS p_dos, w4*1.0E0/t AS p_portscan
FROM (SELECT *, w1+w2+w3+w4 AS t FROM (
  SELECT flow_seq, session_id, current_state AS y_pred,
    CASE WHEN label = 'BENIGN' THEN 'BENIGN' WHEN label = 'DDoS' THEN 'DDoS' WHEN label = 'PortScan' THEN 'PortScan'
         WHEN label = 'FTP-Patator' THEN NULL ELSE 'DoS' END AS y_true,
    1 + (flow_seq * 3) % 7 + CASE WHEN current_state = 'BENIGN' THEN 12 ELSE 0 END AS w1,
    1 + (flow_seq * 5) % 7 + CASE WHEN current_state = 'DDoS' THEN 12 ELSE 0 END AS w2,
    1 + (flow_seq * 2) % 7 + CASE WHEN current_state = 'DoS' THEN 12 ELSE 0 END AS w3,
    1 + (flow_seq * 4) % 7 + CASE WHEN current_state = 'PortScan' THEN 12 ELSE 0 END AS w4
  FROM {flows} WHERE current_state <> 'INVALID_FEATURES') a) b
WHERE y_true IS NOT NULL
"""

#: A packet trace in microseconds: bursts of an order's lines in one of 61 conversations, with pauses of seconds and minutes,
#: both directions, all flags, and closing packets.
TRACE_SQL = """
SELECT (l_orderkey * 10 + l_linenumber) * 10000000 + h AS packet_no,
  1767225600000000 + o * 60000 + o % 11 * 300000 + CAST(floor(o / 3000) AS BIGINT) * 200000000 + n * 150000 + h % 4 * 30000 AS us,
  CASE WHEN from_a THEN a_ip ELSE b_ip END AS src_ip, CASE WHEN from_a THEN b_ip ELSE a_ip END AS dst_ip,
  CASE WHEN from_a THEN a_port ELSE b_port END AS src_port, CASE WHEN from_a THEN b_port ELSE a_port END AS dst_port,
  CASE WHEN tcp THEN 'TCP' ELSE 'UDP' END AS protocol, CAST(CASE WHEN h % 6 = 0 THEN 0 ELSE 20 + h % 1400 END AS INT) AS payload_len,
  CAST(CASE WHEN tcp THEN 20 + h % 4 * 4 ELSE 8 END AS INT) AS header_len, CASE WHEN tcp THEN CAST(h * 37 % 65536 AS INT) END AS tcp_window,
  tcp AND h % 83 = 0 AS fin, tcp AND n = 1 AND h % 3 = 0 AS syn, tcp AND h % 97 = 0 AS rst, tcp AND h % 4 = 1 AS psh, tcp AND n > 1 AS ack,
  tcp AND h % 41 = 0 AS urg, tcp AND h % 53 = 0 AS cwr, tcp AND h % 47 = 0 AS ece
FROM (SELECT *, l_orderkey AS o, l_linenumber AS n, l_partkey AS h, l_orderkey % 61 % 5 <> 4 AS tcp,
        concat('10.1.0.', CAST(l_orderkey % 61 AS STRING)) AS a_ip, CAST(1024 + l_orderkey % 61 % 8 AS INT) AS a_port,
        concat('10.2.0.', CAST(l_orderkey % 61 % 5 AS STRING)) AS b_ip, CAST(80 + l_orderkey % 61 % 3 AS INT) AS b_port,
        CASE WHEN l_orderkey % 7 = 0 THEN FALSE WHEN l_orderkey % 3 = 0 THEN l_linenumber % 2 = 0 ELSE TRUE END AS from_a FROM {lineitem}) x
"""


#: Export headers that the signature rules know, by feature.
SIGNATURE_HEADERS = {
    " Destination Port": "dst_port", " Total Fwd Packets": "tot_fwd_pkts", " Total Backward Packets": "tot_bwd_pkts",
    "Total Length of Fwd Packets": "totlen_fwd_pkts", " Flow Packets/s": "flow_pkts_s", " SYN Flag Count": "syn_flag_cnt",
    " ACK Flag Count": "ack_flag_cnt",
}
_HELD = SIGNATURE_HEADERS | {
    " Flow Duration": "flow_duration", " Total Length of Bwd Packets": "totlen_bwd_pkts", "FIN Flag Count": "fin_flag_cnt",
    " RST Flag Count": "rst_flag_cnt", " PSH Flag Count": "psh_flag_cnt", " URG Flag Count": "urg_flag_cnt",
    " Flow IAT Mean": "flow_iat_mean", " Flow IAT Min": "flow_iat_min", " Flow IAT Max": "flow_iat_max",
    " Average Packet Size": "pkt_size_avg", " Max Packet Length": "pkt_len_max",
}


def feature_code(position: int) -> str:
    """Short column name of the feature at a position of FLOW_FEATURES."""
    return f"f{position:02d}"


def wide_sql(flows: str, keep: Sequence[str] = ()) -> str:
    """All 77 features of every flow under their short names: those of the flow table, and whole numbers for the others.

    `keep` names further columns of the flow table.
    """
    columns = [
        f"CAST({_HELD[name]} AS DOUBLE) AS {feature_code(i)}" if name in _HELD
        else f"CAST((flow_seq * {2 * i + 3}) % {i + 11} AS DOUBLE) AS {feature_code(i)}"
        for i, name in enumerate(FLOW_FEATURES)
    ]
    ids = ", ".join(["flow_seq, session_id, timestamp, src_ip, dst_ip, src_port, dst_port, protocol, label, current_state", *keep])
    return f"SELECT {ids}, {', '.join(columns)} FROM {flows}"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table; zone-less timestamps become UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in naive}) if naive else df


def derive_flows(spark: SparkSession, directory: str) -> DataFrame:
    """Labelled flows, one per event."""
    return spark.sql(FLOWS_SQL, events=read_table(spark, directory, "events"))


def derive_packets(spark: SparkSession, directory: str) -> DataFrame:
    """Packets, one per order line."""
    return spark.sql(PACKETS_SQL, lineitem=read_table(spark, directory, "lineitem"))


def derive_trace(spark: SparkSession, directory: str) -> DataFrame:
    """Packets with flags and microseconds, one per order line."""
    rows = spark.sql(TRACE_SQL, lineitem=read_table(spark, directory, "lineitem"))
    return rows.withColumn("ts", F.timestamp_micros("us")).drop("us")


def derive_scored(spark: SparkSession, directory: str) -> DataFrame:
    """Truth, prediction and four class probabilities per scored flow."""
    return spark.sql(SCORED_SQL, flows=derive_flows(spark, directory))
