"""Registered queries: streaming operators run to the end of the given tables."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netstate.catalog import models
from netstate.catalog.attacks import KEY, KEYED
from netstate.catalog.models import ORACLE as ORACLE_OF_MODELS
from netstate.catalog.shaping import HOUR, rounded, time_text
from netstate.catalog.sql import FLOWS, PACKETS, states, with_ctes
from netstate.catalog.windows import GAP, TRANSITIONS
from netstate.operators import modeling as ml
from netstate.operators.metrics import PROBABILITIES
from netstate.operators.states import window_states
from netstate.scale import ensure_checkpoint_dir
from netstate.sources.tables import FLOWS_SQL, PACKETS_SQL, derive_flows, read_table
from netstate.streaming import flows as stream
from netstate.streaming import late

QUERIES = {}
ORACLE = {}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _table_stream(spark: SparkSession, d: str, name: str, time: str) -> DataFrame:
    """A parquet table as a stream of files, with UTC timestamps."""
    schema = read_table(spark, d, name).schema
    stored = spark.read.parquet(f"{d}/{name}.parquet").schema
    rows = spark.readStream.schema(stored).parquet(f"{d}/{name}.parquet*")
    return rows.withColumn(time, F.col(time).cast(schema[time].dataType))


def _flow_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(FLOWS_SQL, events=_table_stream(spark, d, "events", "ts"))


def _run(rows: DataFrame) -> DataFrame:
    """Everything the stream emits, as a table."""
    spark = rows.sparkSession
    folder = _folder(spark)
    stream.write_available(rows, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


CLOSED = "closed AS (SELECT max(epoch_us(timestamp)) // 1000 * 1000 - {delay} * 1000000 AS mark FROM flows)"


@query(
    with_ctes(FLOWS, CLOSED.format(delay=60),
        "_h AS (SELECT *, epoch_us(timestamp) // 3600000000 * 3600000000 AS w FROM flows)",
        """_a AS (SELECT session_id, w, count(*) AS flow_count, count(DISTINCT src_ip) AS unique_src_ip_count, count(DISTINCT dst_ip) AS unique_dst_ip_count, count(DISTINCT src_port) AS unique_src_port_count,
  count(DISTINCT dst_port) AS unique_dst_port_count, sum(totlen_fwd_pkts + totlen_bwd_pkts) AS total_bytes, sum(ack_flag_cnt) AS ack_count, sum(psh_flag_cnt) AS psh_count, min(flow_iat_min) AS min_iat, max(flow_iat_max) AS max_iat,
  avg(flow_duration) AS mean_flow_duration, max(flow_duration) AS max_flow_duration, avg(pkt_size_avg) AS mean_packet_size, sum(tot_fwd_pkts + tot_bwd_pkts) AS total_packets, sum(syn_flag_cnt) AS syn_count, avg(flow_iat_mean) AS mean_iat,
  coalesce(var_samp(flow_iat_mean), 0) AS iat_variance, max(pkt_len_max) AS max_packet_size, count(*) FILTER (WHERE current_state = 'BENIGN') AS b, count(*) FILTER (WHERE current_state = 'DDoS') AS d,
  count(*) FILTER (WHERE current_state = 'DoS') AS o, count(*) FILTER (WHERE current_state = 'PortScan') AS p FROM _h GROUP BY 1, 2)""")
    + """SELECT session_id, strftime(make_timestamp(w), '%Y-%m-%d %H:%M:%S.%f') AS window_start, flow_count, unique_src_ip_count, unique_dst_ip_count, unique_src_port_count, unique_dst_port_count, total_bytes, ack_count, psh_count,
  round(min_iat, 6) AS min_iat, round(max_iat, 6) AS max_iat, round(mean_flow_duration, 4) AS mean_flow_duration, round(max_flow_duration, 4) AS max_flow_duration, round(mean_packet_size, 6) AS mean_packet_size,
  total_packets, syn_count, round(mean_iat, 6) AS mean_iat, round(sqrt(iat_variance), 6) AS iat_deviation, max_packet_size, CASE greatest(b, d, o, p) WHEN b THEN 'BENIGN' WHEN d THEN 'DDoS' WHEN o THEN 'DoS' ELSE 'PortScan' END AS dominant_state FROM _a, closed WHERE b + d + o + p > 0 AND w + 3600000000 <= mark"""
)
def stream_states(spark: SparkSession, d: str) -> DataFrame:
    out = _run(stream.state_stream(_flow_stream(spark, d), HOUR, exact_endpoints=True))
    out = out.select(
        "session_id", time_text("window_start").alias("window_start"), "flow_count",
        *[f"unique_{c}_count" for c in ("src_ip", "dst_ip", "src_port", "dst_port")], "total_bytes", "ack_count", "psh_count",
        "min_iat", "max_iat", "mean_flow_duration", "max_flow_duration", "mean_packet_size", "total_packets", "syn_count",
        "mean_iat", F.sqrt("iat_variance").alias("iat_deviation"), "max_packet_size", "dominant_state",
    )
    out = rounded(out, ["mean_iat", "iat_deviation", "min_iat", "max_iat", "mean_packet_size"])
    return rounded(out, ["mean_flow_duration", "max_flow_duration"], 4)


@query(
    with_ctes(FLOWS, CLOSED.format(delay=30), """_b AS (SELECT *, epoch_us(timestamp) // 21600000000 * 21600000000 AS bucket FROM flows),
_s AS (SELECT bucket, dst_ip AS victim, src_ip, count(*) AS n, sum(tot_fwd_pkts + tot_bwd_pkts) AS pk FROM _b GROUP BY 1, 2, 3),
_v AS (SELECT bucket, victim, count(*) AS unique_sources, max(n) AS top, sum(n) AS n, sum(pk) AS pk FROM _s GROUP BY 1, 2)""")
    + """SELECT strftime(make_timestamp(bucket), '%Y-%m-%d %H:%M:%S.%f') AS window_start, victim, unique_sources, CAST(n AS BIGINT) AS flow_count, round(n / total, 4) AS victim_flow_ratio,
  round(top / n, 4) AS top_source_flow_ratio, round(pk / 21600.0E0, 4) AS packet_rate, 'DDoS' AS state FROM _v JOIN (SELECT bucket, count(*) AS total FROM _b GROUP BY 1) USING (bucket), closed
  WHERE unique_sources >= 20 AND n / total >= 0.5E0 AND top / n <= 0.25E0 AND pk / 21600.0E0 >= 0.01E0 AND bucket + 21600000000 <= mark"""
)
def stream_flood_alerts(spark: SparkSession, d: str) -> DataFrame:
    alerts = stream.flood_alert_stream(_flow_stream(spark, d), 21600, min_packet_rate=0.01)
    return _run(alerts).withColumn("window_start", time_text("window_start"))


@query(with_ctes(FLOWS, states(where=GAP), TRANSITIONS) + "SELECT * FROM tr WHERE next_window IS NOT NULL")
def stream_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Window states arrive as files; the processor keeps the last window of each session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = _folder(spark)
    window_states(derive_flows(spark, d), HOUR).where(GAP).write.parquet(f"{folder}/states")
    schema = spark.read.parquet(f"{folder}/states").schema
    found = _run(stream.transition_stream(spark.readStream.schema(schema).parquet(f"{folder}/states")))
    return found.where("not late").drop("late")


@query(
    with_ctes(PACKETS, KEYED, "m AS (SELECT max(epoch_us(ts)) - 60000000 AS mark FROM packets)",
        f"o AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY {KEY} ORDER BY ts, packet_no) AS p FROM keyed)",
        f"n AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > 2592000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY us, packet_no) AS f FROM o)")
    + f"""SELECT {KEY}, strftime(make_timestamp(min(us)), '%Y-%m-%d %H:%M:%S.%f') AS first_packet, count(*) AS packets, CAST(sum(payload_len) AS BIGINT) AS bytes, count(*) FILTER (WHERE syn) AS syn_flag_cnt,
  CAST(max(payload_len) AS INT) AS pkt_len_max, CAST(max(us) - min(us) AS DOUBLE) AS flow_duration FROM n GROUP BY {KEY}, f HAVING max(us) + 2592000000000 <= (SELECT mark FROM m)"""
)
def stream_flow_assembly(spark: SparkSession, d: str) -> DataFrame:
    packets = spark.sql(PACKETS_SQL, lineitem=_table_stream(spark, d, "lineitem", "l_shipdate"))
    out = _run(stream.flow_stream(packets, 30 * 86400))
    return out.withColumn("first_packet", time_text("first_packet"))


@query(
    with_ctes(FLOWS, CLOSED.format(delay=30), """_b AS (SELECT *, epoch_us(timestamp) // 600000000 * 600000000 AS bucket FROM flows),
_s AS (SELECT bucket, dst_ip AS victim, src_ip, count(*) AS n, sum(tot_fwd_pkts + tot_bwd_pkts) AS pk, sum(syn_flag_cnt) AS syn, sum(ack_flag_cnt) AS ack FROM _b GROUP BY 1, 2, 3),
_v AS (SELECT bucket, victim, count(*) AS sources, sum(n) AS n, sum(pk) AS pk, sum(syn) AS syn, sum(ack) AS ack FROM _s GROUP BY 1, 2)""")
    + """SELECT strftime(make_timestamp(bucket), '%Y-%m-%d %H:%M:%S.%f') AS window_start, victim, CAST(n AS BIGINT) AS flow_count, round(pk / 600.0E0, 4) AS packet_rate, round(syn, 4) AS syn_count, 'DoS' AS state
  FROM _v, closed WHERE sources = 1 AND syn >= 20 AND CASE WHEN syn <> 0 THEN ack / syn ELSE 1 END <= 0.2E0 AND pk / 600.0E0 >= 0.05E0 AND bucket + 600000000 <= mark"""
)
def stream_single_source_alerts(spark: SparkSession, d: str) -> DataFrame:
    alerts = stream.single_source_alert_stream(_flow_stream(spark, d), 600, min_packet_rate=0.05)
    return _run(alerts).withColumn("window_start", time_text("window_start"))


@query(with_ctes(FLOWS) + "SELECT flow_seq, session_id FROM flows")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Every flow arrives twice."""
    twice = _flow_stream(spark, d).unionByName(_flow_stream(spark, d))
    return _run(stream.deduplicated(twice, ["flow_seq"])).select("flow_seq", "session_id")


@query(
    with_ctes(PACKETS, "m AS (SELECT max(epoch_us(ts)) - 10000000 AS mark FROM packets)",
        "w AS (SELECT (epoch_us(ts) // 864000000000 - i) * 864000000000 AS start FROM packets, range(0, 3) r(i))")
    + "SELECT strftime(make_timestamp(start), '%Y-%m-%d %H:%M:%S.%f') AS window_start, round(count(*) / 2592000.0E0, 8) AS packets_per_second FROM w, m WHERE start + 2592000000000 <= mark GROUP BY start"
)
def stream_packet_rates(spark: SparkSession, d: str) -> DataFrame:
    """Packets per second over 30 days, every ten days."""
    packets = spark.sql(PACKETS_SQL, lineitem=_table_stream(spark, d, "lineitem", "l_shipdate"))
    rates = _run(stream.packet_rate_stream(packets, "30 days", "10 days"))
    return rounded(rates.withColumn("window_start", time_text("window_start")), ["packets_per_second"], 8)


@query(ORACLE_OF_MODELS["linear_scores"])
def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Flows scored by given coefficients as they arrive."""
    folder = _folder(spark)
    rows = _flow_stream(spark, d)
    inputs = F.array(*[models.GIVEN_SCALER.scaled(f, F.col(f).cast("double")) for f in models.FLOW_FEATURES])
    vectors = rows.select("flow_seq", array_to_vector(inputs).alias("features"))

    def sink(batch: DataFrame, number: int) -> None:
        ml.with_probabilities(batch).drop("features").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.scored_stream(vectors, models.GIVEN, sink, f"{folder}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").drop("batch"), PROBABILITIES)


@query(with_ctes(FLOWS) + "SELECT trim(label) AS label, count(*) AS rows FROM flows GROUP BY 1")
def stream_flow_files(spark: SparkSession, d: str) -> DataFrame:
    """CSV files of flows as a stream, two files at a time."""
    folder = _folder(spark)
    flows = derive_flows(spark, d).select("flow_seq", "label")
    flows.repartitionByRange(4, "flow_seq").write.option("header", True).csv(f"{folder}/in")
    live = stream.flow_file_stream(spark, f"{folder}/in", StructType.fromDDL("flow_seq long, label string"), "csv", 2)
    return _run(live).groupBy(F.trim("label").alias("label")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    with_ctes(FLOWS, CLOSED.format(delay=60), "_h AS (SELECT *, epoch_us(timestamp) // 3600000000 * 3600000000 AS w FROM flows)")
    + """SELECT strftime(make_timestamp(w // 86400000000 * 86400000000), '%Y-%m-%d %H:%M:%S.%f') AS day, count(DISTINCT src_ip) AS unique_src_ip_count, count(DISTINCT dst_ip) AS unique_dst_ip_count,
  count(DISTINCT src_port) AS unique_src_port_count, count(DISTINCT dst_port) AS unique_dst_port_count FROM _h, closed WHERE w + 3600000000 <= mark GROUP BY 1"""
)
def stream_endpoint_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct endpoints of a day, merged from the sketches of its sessions' hours; exact as long as there are few."""
    sketches = _run(late.endpoint_sketch_stream(_flow_stream(spark, d), HOUR))
    return late.merged_endpoints(sketches, [time_text(F.date_trunc("day", "window_start")).alias("day")])


_FIRST = "flow_seq % 10 <> 0"
_BEHIND = "epoch_us(timestamp) <= (SELECT max(epoch_us(timestamp)) FROM flows WHERE flow_seq % 10 <> 0) - 432000000000"


@query(
    with_ctes(FLOWS)
    + f"""SELECT 'accepted' AS kind, count(*) FILTER (WHERE {_FIRST}) + count(*) FILTER (WHERE NOT ({_FIRST}) AND NOT ({_BEHIND})) AS rows FROM flows
  UNION ALL SELECT 'late', count(*) FILTER (WHERE NOT ({_FIRST}) AND {_BEHIND}) + count(*) FILTER (WHERE flow_seq % 7 = 0 AND {_BEHIND}) FROM flows
  UNION ALL SELECT 'duplicate', count(*) FILTER (WHERE flow_seq % 7 = 0 AND NOT ({_BEHIND})) FROM flows"""
)
def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nine tenths of the flows, then the rest and a repeat of every seventh; what lies five days behind is late."""
    folder = _folder(spark)
    flows = derive_flows(spark, d)
    for part in (flows.where(_FIRST), flows.where(f"NOT ({_FIRST})").unionByName(flows.where("flow_seq % 7 = 0"))):
        part.write.mode("append").parquet(f"{folder}/in")
        # A run takes all new files as one batch, however many tasks wrote them; the next one goes on from its checkpoint.
        live = spark.readStream.schema(flows.schema).parquet(f"{folder}/in")
        late.sort_out(live, ["flow_seq"], f"{folder}/sorted", f"{folder}/checkpoint", delay_seconds=5 * 86_400).awaitTermination()
    return late.sorted_counts(spark, f"{folder}/sorted")
