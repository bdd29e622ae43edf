"""Registered queries: flow signatures, verdicts, packet features and flow assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.catalog.shaping import rounded, time_text
from netstate.catalog.sql import FLOWS, PACKETS, with_ctes
from netstate.functions.labels import effective_state
from netstate.functions.values import contains_text, encode_label, first_filled, flow_value_panel, one_hot
from netstate.constants import STATE_CLASSES
from netstate.operators import packets as pk
from netstate.operators import signatures as sig
from netstate.operators.metrics import agreement, time_histogram
from netstate.operators.transitions import packet_rates
from netstate.sources.tables import derive_flows, derive_packets, read_table

QUERIES = {}
ORACLE = {}

# Events are sparse, so flood buckets are six hours long and rates per second are low.
FLOOD = {"bucket_seconds": 21600, "min_packet_rate": 0.01, "min_victim_share": 0.4}
SYN = {"min_packet_rate": 700.0}
SWEEP = {"min_ports": 30}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


EVIDENCE = """_b AS (SELECT *, epoch_us(timestamp) // 21600000000 * 21600000000 AS bucket FROM flows),
_s AS (SELECT bucket, dst_ip AS victim, src_ip, count(*) AS n, sum(tot_fwd_pkts + tot_bwd_pkts) AS pk, sum(syn_flag_cnt) AS syn, sum(ack_flag_cnt) AS ack
  FROM _b GROUP BY 1, 2, 3),
_v AS (SELECT bucket, victim, count(*) AS unique_sources, max(n) AS top, sum(n) AS n, sum(pk) AS pk, sum(syn) AS syn, sum(ack) AS ack FROM _s GROUP BY 1, 2),
evidence AS (SELECT _v.*, n / total AS share, top / n AS top_share, pk / 21600.0E0 AS rate, ack / nullif(syn, 0) AS ratio,
  CASE WHEN pk / 21600.0E0 >= 0.01E0 THEN CASE WHEN unique_sources >= 20 AND n / total >= 0.4E0 AND top / n <= 0.25E0 THEN 'DDoS'
    WHEN unique_sources = 1 AND syn >= 20 AND coalesce(ack / nullif(syn, 0), 1) <= 0.2E0 THEN 'DoS' END END AS state
  FROM _v JOIN (SELECT bucket, count(*) AS total FROM _b GROUP BY 1) USING (bucket))"""


@query(
    with_ctes(FLOWS, EVIDENCE)
    + """SELECT strftime(make_timestamp(bucket), '%Y-%m-%d %H:%M:%S.%f') AS window_start, victim, unique_sources, CAST(n AS BIGINT) AS flow_count,
  round(share, 4) AS victim_flow_ratio, round(top_share, 4) AS top_source_flow_ratio, round(rate, 4) AS packet_rate, round(syn, 4) AS syn_count,
  round(ratio, 4) AS ack_to_syn_ratio, state FROM evidence"""
)
def flood_evidence(spark: SparkSession, d: str) -> DataFrame:
    return sig.flood_evidence(derive_flows(spark, d), **FLOOD).withColumn("window_start", time_text("window_start"))


@query(
    with_ctes(FLOWS)
    + """SELECT flow_seq, syn_flag_cnt, ack_flag_cnt FROM flows WHERE syn_flag_cnt >= 20 AND ack_flag_cnt <= syn_flag_cnt * 0.2E0 AND flow_pkts_s >= 700"""
)
def syn_flood_flows(spark: SparkSession, d: str) -> DataFrame:
    flows = derive_flows(spark, d)
    return flows.where(sig.is_syn_flood(flows, **SYN)).select("flow_seq", "syn_flag_cnt", "ack_flag_cnt")


SWEEPS = """_g AS (SELECT src_ip AS src, dst_ip AS dst, count(DISTINCT dst_port) FILTER (WHERE dst_port > 0) AS unique_ports, count(*) AS flow_count,
  avg(totlen_fwd_pkts) AS mean_fwd_bytes FROM flows GROUP BY 1, 2),
sweeps AS (SELECT * FROM _g WHERE unique_ports >= {ports} AND mean_fwd_bytes <= 400)"""

WALKS = """_p AS (SELECT src_ip AS src, dst_ip AS dst, dst_port AS port, abs(dst_port - lag(dst_port) OVER (PARTITION BY src_ip, dst_ip ORDER BY flow_seq)) AS step FROM flows),
walks AS (SELECT src, dst, count(DISTINCT port) AS u, min(port) AS lo, max(port) AS hi, count(step) AS k, count(*) FILTER (WHERE step = 1) AS one,
  min(step) AS s, max(step) AS l FROM _p GROUP BY 1, 2),
patterns AS (SELECT src, dst, CASE WHEN u < 3 THEN 'none' WHEN hi - lo + 1 = u THEN 'sequential' WHEN one / k >= 0.6E0 THEN 'sequential'
  WHEN s = l AND l > 1 THEN 'strided' ELSE 'randomised' END AS pattern FROM walks)"""


@query(
    with_ctes(FLOWS, SWEEPS.format(ports=30), WALKS)
    + """SELECT src, dst, unique_ports, flow_count, round(mean_fwd_bytes, 6) AS mean_fwd_bytes, pattern FROM sweeps JOIN patterns USING (src, dst)"""
)
def port_sweeps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sig.port_sweeps(derive_flows(spark, d), bits=9, **SWEEP), ["mean_fwd_bytes"])


@query(
    with_ctes(FLOWS, WALKS)
    + "SELECT pattern, count(*) AS pairs FROM patterns GROUP BY 1"
)
def port_walk_patterns(spark: SparkSession, d: str) -> DataFrame:
    contacts = derive_flows(spark, d).select("src_ip", "dst_ip", "flow_seq", F.col("dst_port").alias("port"))
    walks = sig.port_walks(contacts, ["src_ip", "dst_ip"], "flow_seq", bits=9)
    return walks.groupBy("pattern").agg(F.count(F.lit(1)).alias("pairs"))


@query(
    with_ctes(FLOWS, SWEEPS.format(ports=30))
    + "SELECT src, dst, unique_ports FROM sweeps ORDER BY unique_ports DESC, src, dst LIMIT 1"
)
def largest_sweep(spark: SparkSession, d: str) -> DataFrame:
    return sig.largest_sweep(sig.port_sweeps(derive_flows(spark, d), **SWEEP)).select("src", "dst", "unique_ports")


SIGNED = """signed AS (SELECT f.*, coalesce(e.state, CASE WHEN syn_flag_cnt >= 20 AND ack_flag_cnt <= syn_flag_cnt * 0.2E0 AND flow_pkts_s >= 700 THEN 'DoS' END,
  CASE WHEN s.src IS NOT NULL THEN 'PortScan' END, 'BENIGN') AS signature_state
  FROM _b f LEFT JOIN (SELECT bucket, victim, state FROM evidence WHERE state IS NOT NULL) e ON f.bucket = e.bucket AND f.dst_ip = e.victim
  LEFT JOIN sweeps s ON s.src = f.src_ip AND s.dst = f.dst_ip),
effective AS (SELECT *, CASE WHEN signature_state <> 'BENIGN' AND current_state IN ('BENIGN', 'INVALID_FEATURES') THEN signature_state ELSE current_state END AS effective_state FROM signed)"""
SIGNATURE_CTES = (FLOWS, EVIDENCE, SWEEPS.format(ports=30), SIGNED)


def _signed(spark: SparkSession, d: str) -> DataFrame:
    signed = sig.signature_states(derive_flows(spark, d), FLOOD, SYN, SWEEP)
    return signed.withColumn("effective_state", effective_state(F.col("current_state"), F.col("signature_state")))


@query(with_ctes(*SIGNATURE_CTES) + "SELECT flow_seq, current_state, signature_state, effective_state FROM effective")
def signature_states(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d).select("flow_seq", "current_state", "signature_state", "effective_state")


@query(
    with_ctes(*SIGNATURE_CTES, WALKS)
    + """SELECT CASE state WHEN 'DDoS' THEN 'rolling-source-fanin-flood' ELSE 'rolling-single-source-syn-flood' END AS rule, state, CAST(n AS BIGINT) AS flow_count,
  CASE state WHEN 'DDoS' THEN printf('%d concurrent sources -> %s at %.0f observed packets/s', unique_sources, victim, round(rate, 4)) ELSE printf('single source -> %s at %.0f observed packets/s', victim, round(rate, 4)) END AS detail
  FROM evidence WHERE state IS NOT NULL
  UNION ALL SELECT 'syn-flood', 'DoS', count(*), printf('%d flow(s) with SYN>=20, few ACKs, >=700 pkts/s', count(*)) FROM flows WHERE syn_flag_cnt >= 20 AND ack_flag_cnt <= syn_flag_cnt * 0.2E0 AND flow_pkts_s >= 700
  UNION ALL SELECT 'port-sweep', 'PortScan', flow_count, printf('%s -> %s: %d distinct ports, %s order, %.0f avg fwd bytes', src, dst, unique_ports, pattern, mean_fwd_bytes) FROM sweeps JOIN patterns USING (src, dst)"""
)
def signature_hits(spark: SparkSession, d: str) -> DataFrame:
    return sig.signature_hits(derive_flows(spark, d), FLOOD, SYN, SWEEP).select("rule", "state", "flow_count", "detail")


@query(
    with_ctes(*SIGNATURE_CTES)
    + """SELECT CASE WHEN count(*) FILTER (WHERE signature_state = 'DDoS') > 0 THEN 'DDoS' WHEN count(*) FILTER (WHERE signature_state = 'DoS') > 0 THEN 'DoS'
  WHEN count(*) FILTER (WHERE signature_state = 'PortScan') > 0 THEN 'PortScan' END AS attack_class FROM signed"""
)
def attack_class(spark: SparkSession, d: str) -> DataFrame:
    return sig.attack_class(_signed(spark, d))


def _verdict_sql(source: str, column: str, keys: str = "") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""_c AS (SELECT {lead}count(*) FILTER (WHERE {column} = 'BENIGN') AS b, count(*) FILTER (WHERE {column} = 'DDoS') AS d,
  count(*) FILTER (WHERE {column} = 'DoS') AS o, count(*) FILTER (WHERE {column} = 'PortScan') AS p FROM {source} {group}),
_k AS (SELECT *, b + d + o + p AS n, d + o + p AS a, CASE WHEN d + o + p = 0 THEN NULL WHEN greatest(d, o, p) = d THEN 'DDoS' WHEN greatest(d, o, p) = o THEN 'DoS' ELSE 'PortScan' END AS top FROM _c),
_r AS (SELECT *, CASE WHEN top IS NULL OR n = 0 THEN 0 ELSE round_even(greatest(d, o, p) / n, 4) END AS own FROM _k)
SELECT {lead}CASE greatest(b, d, o, p) WHEN b THEN 'BENIGN' WHEN d THEN 'DDoS' WHEN o THEN 'DoS' ELSE 'PortScan' END AS dominant_state,
  n AS scored_flow_count, a AS attack_flow_count, CASE WHEN n = 0 THEN 0 ELSE round_even(a / n, 4) END AS malicious_flow_ratio, own AS attack_class_ratio, a > 0 AS attack_present,
  top AS attack_class, CASE WHEN top IS NULL THEN 'BENIGN' WHEN own >= 0.2E0 THEN 'ATTACK — ' || top ELSE 'SUSPICIOUS — ' || top || '?' END AS verdict,
  CASE WHEN top IS NULL THEN 'none' WHEN own >= 0.2E0 THEN 'high' ELSE 'low' END AS confidence FROM _r"""


@query(with_ctes(FLOWS, _verdict_sql("flows", "current_state")))
def capture_verdict(spark: SparkSession, d: str) -> DataFrame:
    return sig.capture_verdict(derive_flows(spark, d))


@query(with_ctes(*SIGNATURE_CTES, _verdict_sql("effective", "effective_state", "session_id")))
def effective_verdict_by_session(spark: SparkSession, d: str) -> DataFrame:
    return sig.capture_verdict(_signed(spark, d), "effective_state", keys=["session_id"])


@query(
    with_ctes(*SIGNATURE_CTES,
        "ok AS (SELECT current_state AS p, effective_state AS t FROM effective WHERE current_state <> 'INVALID_FEATURES')",
        """f AS (SELECT c, 2.0E0 * count(*) FILTER (WHERE t = c AND p = c) / nullif(count(*) FILTER (WHERE t = c) + count(*) FILTER (WHERE p = c), 0) AS f1,
  count(*) FILTER (WHERE t = c) AS s FROM ok, (VALUES ('BENIGN'), ('DDoS'), ('DoS'), ('PortScan')) v(c) GROUP BY c)""")
    + """SELECT (SELECT count(*) FROM ok) AS n, round((SELECT avg(CAST(t = p AS INT)) FROM ok), 6) AS agreement_rate, round(avg(coalesce(f1, 0)), 6) AS macro_f1,
  round(sum(coalesce(f1, 0) * s) / sum(s), 6) AS weighted_f1 FROM f"""
)
def labeler_agreement(spark: SparkSession, d: str) -> DataFrame:
    out = agreement(_signed(spark, d), "current_state", "effective_state")
    return rounded(out, ["agreement_rate", "macro_f1", "weighted_f1"])


@query(
    with_ctes(FLOWS, "b AS (SELECT min(epoch_ms(timestamp)) AS t0, max(epoch_ms(timestamp)) AS t1 FROM flows)")
    + """SELECT CAST(least(119, floor((epoch_ms(timestamp) - t0) / CAST(t1 - t0 AS DOUBLE) * 120)) AS INT) AS bin,
  count(*) FILTER (WHERE current_state = 'BENIGN') AS benign, count(*) FILTER (WHERE current_state <> 'BENIGN') AS attack FROM flows, b GROUP BY 1"""
)
def flow_time_histogram(spark: SparkSession, d: str) -> DataFrame:
    return time_histogram(derive_flows(spark, d), state="current_state")


@query(
    with_ctes(FLOWS)
    + """SELECT flow_seq, round(flow_duration, 4) AS flow_duration, CASE WHEN isinf(flow_pkts_s) THEN -1 ELSE round(flow_pkts_s, 4) END AS flow_pkts_s,
  round(flow_iat_mean, 4) AS flow_iat_mean, '0x' || lpad(to_hex(CAST(CASE WHEN ack_flag_cnt > 0 THEN 16 ELSE 0 END + CASE WHEN psh_flag_cnt > 0 THEN 8 ELSE 0 END
    + CASE WHEN rst_flag_cnt > 0 THEN 4 ELSE 0 END + CASE WHEN syn_flag_cnt > 0 THEN 2 ELSE 0 END + CASE WHEN fin_flag_cnt > 0 THEN 1 ELSE 0 END AS BIGINT)), 2, '0') AS tcp_flag_bitmask,
  '.' || CASE WHEN ack_flag_cnt > 0 THEN 'A' ELSE '.' END || CASE WHEN psh_flag_cnt > 0 THEN 'P' ELSE '.' END || CASE WHEN rst_flag_cnt > 0 THEN 'R' ELSE '.' END
    || CASE WHEN syn_flag_cnt > 0 THEN 'S' ELSE '.' END || CASE WHEN fin_flag_cnt > 0 THEN 'F' ELSE '.' END AS tcp_flags FROM flows"""
)
def flow_values(spark: SparkSession, d: str) -> DataFrame:
    panel = flow_value_panel(derive_flows(spark, d))
    rate = F.when(F.abs("flow_pkts_s") == float("inf"), F.lit(-1.0)).otherwise(F.col("flow_pkts_s"))
    return panel.select(
        "flow_seq", "flow_duration", rate.alias("flow_pkts_s"), "flow_iat_mean", "tcp_flag_bitmask", "tcp_flags"
    )


@query(
    with_ctes(FLOWS)
    + """SELECT flow_seq, src_ip, current_state FROM flows WHERE contains(lower(concat(src_ip, ' ', dst_ip)), '.9') AND contains(lower(label), 'dos') AND current_state = 'DoS'"""
)
def filtered_flows(spark: SparkSession, d: str) -> DataFrame:
    flows = derive_flows(spark, d)
    wanted = contains_text(F.concat_ws(" ", "src_ip", "dst_ip"), " .9 ") & contains_text(F.col("label"), "DOS")
    return flows.where(wanted & (F.col("current_state") == "DoS")).select("flow_seq", "src_ip", "current_state")


@query(
    with_ctes(FLOWS)
    + """SELECT flow_seq, coalesce(nullif(trim(label), ''), current_state) AS shown, CAST(CASE current_state WHEN 'BENIGN' THEN 0 WHEN 'DDoS' THEN 1 WHEN 'DoS' THEN 2 WHEN 'PortScan' THEN 3 ELSE -1 END AS INT) AS encoded,
  CAST(current_state = 'DDoS' AS INT) AS is_ddos FROM flows"""
)
def encoded_flows(spark: SparkSession, d: str) -> DataFrame:
    hot = one_hot(F.col("current_state"), STATE_CLASSES)
    return derive_flows(spark, d).select(
        "flow_seq", first_filled(F.trim("label"), F.col("current_state")).alias("shown"),
        F.coalesce(encode_label(F.col("current_state"), STATE_CLASSES), F.lit(-1)).alias("encoded"), hot[1].alias("is_ddos"),
    )


KEYED = """_k AS (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS fwd FROM packets),
keyed AS (SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN fwd THEN src_port ELSE dst_port END AS port_a,
  CASE WHEN fwd THEN dst_ip ELSE src_ip END AS ip_b, CASE WHEN fwd THEN dst_port ELSE src_port END AS port_b FROM _k)"""
KEY = "ip_a, port_a, ip_b, port_b, protocol"
MARKED = f"""marked AS (SELECT {KEY}, count(*) - 1 AS again FROM keyed WHERE protocol = 'TCP' AND (payload_len > 0 OR syn)
  GROUP BY {KEY}, src_ip, src_port, tcp_seq, payload_len)"""


@query(
    with_ctes(PACKETS, KEYED, MARKED,
        f"""g AS (SELECT {KEY}, count(*) AS packet_count, round(avg(ttl), 3) AS ttl_mean, round(stddev_pop(ttl), 3) AS ttl_std,
  round(coalesce(avg(tcp_window) FILTER (WHERE protocol = 'TCP'), 0), 3) AS tcp_window_mean, CAST(coalesce(min(tcp_window) FILTER (WHERE protocol = 'TCP'), 0) AS DOUBLE) AS tcp_window_min,
  count(*) FILTER (WHERE is_fragment) AS ip_fragment_count, round(avg(payload_len), 3) AS payload_len_mean, round(stddev_pop(payload_len), 3) AS payload_len_std FROM keyed GROUP BY ALL)""",
        f"r AS (SELECT {KEY}, CAST(sum(again) AS BIGINT) AS retransmission_count FROM marked GROUP BY {KEY})")
    + f"SELECT g.*, coalesce(retransmission_count, 0) AS retransmission_count FROM g LEFT JOIN r USING ({KEY})"
)
def packet_features(spark: SparkSession, d: str) -> DataFrame:
    return pk.packet_features(derive_packets(spark, d))


@query(
    with_ctes(PACKETS, KEYED) + f"SELECT {KEY}, count(*) AS packet_count FROM keyed GROUP BY ALL ORDER BY packet_count DESC, {KEY}"
)
def busiest_conversations(spark: SparkSession, d: str) -> DataFrame:
    return pk.by_packet_count(pk.packet_features(derive_packets(spark, d))).select(*pk.CONVERSATION, "packet_count")


@query(with_ctes(PACKETS, KEYED, MARKED) + f"SELECT {KEY}, CAST(sum(again) AS BIGINT) AS retransmission_count FROM marked GROUP BY {KEY}")
def retransmissions(spark: SparkSession, d: str) -> DataFrame:
    return pk.retransmissions(derive_packets(spark, d))


SCANS = """_f AS (SELECT src_ip, dst_ip, dst_port, min(packet_no) AS f FROM packets WHERE (protocol = 'TCP' AND syn) OR protocol = 'UDP' GROUP BY 1, 2, 3),
_o AS (SELECT *, abs(dst_port - lag(dst_port) OVER (PARTITION BY src_ip, dst_ip ORDER BY f, dst_port)) AS step FROM _f),
_w AS (SELECT src_ip, dst_ip, count(*) AS unique_ports, min(dst_port) AS min_port, max(dst_port) AS max_port, count(step) AS k, count(*) FILTER (WHERE step = 1) AS one,
  min(step) AS s, max(step) AS l FROM _o GROUP BY 1, 2 HAVING count(*) >= 10),
scans AS (SELECT src_ip, dst_ip, unique_ports, min_port, max_port, CASE WHEN max_port - min_port + 1 = unique_ports THEN 'sequential' WHEN one / k >= 0.6E0 THEN 'sequential'
  WHEN s = l AND l > 1 THEN 'strided' WHEN unique_ports >= 20 AND max_port - min_port > unique_ports * 4 THEN 'randomised' ELSE 'none' END AS pattern FROM _w)"""


@query(with_ctes(PACKETS, SCANS) + "SELECT * FROM scans")
def packet_scans(spark: SparkSession, d: str) -> DataFrame:
    return pk.packet_scans(derive_packets(spark, d))


@query(with_ctes(PACKETS, SCANS) + "SELECT * FROM scans WHERE pattern <> 'none' ORDER BY unique_ports DESC, src_ip, dst_ip LIMIT 1")
def largest_packet_scan(spark: SparkSession, d: str) -> DataFrame:
    return pk.largest_scan(pk.packet_scans(derive_packets(spark, d)))


@query(with_ctes(PACKETS) + "SELECT packet_no, src_ip, dst_ip, payload_len FROM packets ORDER BY packet_no LIMIT 100 OFFSET 200")
def packet_page(spark: SparkSession, d: str) -> DataFrame:
    return pk.packet_page(derive_packets(spark, d), 100, 200).select("packet_no", "src_ip", "dst_ip", "payload_len")


@query(with_ctes(PACKETS) + "SELECT packet_no, src_ip, dst_ip FROM packets WHERE packet_no > 1000 AND packet_no <= 2000")
def packet_range(spark: SparkSession, d: str) -> DataFrame:
    return pk.packet_range(derive_packets(spark, d), 1000, 1000).select("packet_no", "src_ip", "dst_ip")


@query(with_ctes(PACKETS) + "SELECT protocol, count(*) AS packet_count, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000 AS duration_seconds FROM packets GROUP BY 1")
def capture_summary(spark: SparkSession, d: str) -> DataFrame:
    return pk.capture_summary(derive_packets(spark, d), ["protocol"])


@query(
    with_ctes(PACKETS, KEYED,
        f"o AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY {KEY} ORDER BY ts, packet_no) AS p FROM keyed)",
        f"""n AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > 2592000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY us, packet_no) AS flow_no,
  CASE WHEN us - p <= 2592000000000 THEN us - p END AS gap FROM o)""",
        f"""g AS (SELECT {KEY}, CAST(flow_no AS BIGINT) AS flow_no, arg_min(fwd, (us, packet_no)) AS forward, min(us) AS a, max(us) AS z, count(*) AS n, count(*) FILTER (WHERE fwd) AS na,
  sum(payload_len) AS b, coalesce(sum(payload_len) FILTER (WHERE fwd), 0) AS ba, avg(gap) AS gm, stddev_samp(gap) AS gs, max(gap) AS gx, min(gap) AS gn, count(*) FILTER (WHERE syn) AS syn,
  max(payload_len) AS mx FROM n GROUP BY ALL)""")
    + """SELECT CASE WHEN forward THEN ip_a ELSE ip_b END AS src_ip, CASE WHEN forward THEN port_a ELSE port_b END AS src_port, CASE WHEN forward THEN ip_b ELSE ip_a END AS dst_ip,
  CASE WHEN forward THEN port_b ELSE port_a END AS dst_port, protocol, flow_no, CAST(z - a AS DOUBLE) AS flow_duration, CASE WHEN forward THEN na ELSE n - na END AS tot_fwd_pkts,
  CASE WHEN forward THEN n - na ELSE na END AS tot_bwd_pkts, CAST(CASE WHEN forward THEN ba ELSE b - ba END AS BIGINT) AS totlen_fwd_pkts,
  CAST(CASE WHEN forward THEN b - ba ELSE ba END AS BIGINT) AS totlen_bwd_pkts, round(coalesce(gm, 0)) AS flow_iat_mean, round(coalesce(gs, 0) / 1000, 2) AS flow_iat_std,
  CAST(coalesce(gx, 0) AS DOUBLE) AS flow_iat_max, CAST(coalesce(gn, 0) AS DOUBLE) AS flow_iat_min, syn AS syn_flag_cnt, round(b / n, 6) AS pkt_size_avg, CAST(mx AS INT) AS pkt_len_max FROM g"""
)
def flow_assembly(spark: SparkSession, d: str) -> DataFrame:
    out = pk.assemble_flows(derive_packets(spark, d), idle_seconds=30 * 86400)
    return out.select(
        "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "flow_no", "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts",
        "totlen_fwd_pkts", "totlen_bwd_pkts", F.round("flow_iat_mean").alias("flow_iat_mean"),
        F.round(F.col("flow_iat_std") / 1000, 2).alias("flow_iat_std"), "flow_iat_max", "flow_iat_min", "syn_flag_cnt",
        F.round("pkt_size_avg", 6).alias("pkt_size_avg"), "pkt_len_max",
    )


@query(
    """SELECT user_id, ts_ms, round(CASE WHEN dt > 0 AND dp >= 0 THEN dp / dt ELSE 0 END, 6) AS packets_per_second FROM (
  SELECT user_id, event_id AS ts_ms, (event_id - lag(event_id) OVER o) / 1000 AS dt, CAST(floor(value) AS BIGINT) - lag(CAST(floor(value) AS BIGINT)) OVER o AS dp,
    lag(event_id) OVER o AS p FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) WHERE p IS NOT NULL"""
)
def counter_rates(spark: SparkSession, d: str) -> DataFrame:
    samples = read_table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("ts_ms"), F.floor("value").alias("packets")
    )
    return rounded(packet_rates(samples, keys=["user_id"], bits=10), ["packets_per_second"])
