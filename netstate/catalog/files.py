"""Registered queries over files that are written from the given tables and read again."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.catalog.attacks import EVIDENCE, FLOOD, SIGNED, SWEEP, SWEEPS, SYN, _verdict_sql
from netstate.catalog.shaping import HOUR, rounded, time_text
from netstate.catalog.sql import FLOWS, SCORED, rounded_features, states, with_ctes
from netstate.catalog.windows import CHRONO, NUMBERED, POSITIONAL
from netstate.constants import FLOW_FEATURES, STATE_CLASSES, STATE_FEATURES
from netstate.functions.columns import (
    align_features, drop_derived, drop_repeated_headers, find_id_columns, find_label_column, match_features, quoted,
)
from netstate.functions.timestamps import parse_timestamps
from netstate.functions.values import capture_log_counts, safe_file_name
from netstate.operators import profile, splits
from netstate.operators import sequences as seq
from netstate.operators.modeling import LinearModel
from netstate.operators.states import window_states
from netstate.operators.transitions import chronological_position, join_predictions
from netstate.plans.label_flows import capture_report, label_flows
from netstate.scale import compile_in_parts, ensure_checkpoint_dir, stage, with_position
from netstate.sources import flow_files as ff
from netstate.sources import sinks
from netstate.sources.tables import (
    SIGNATURE_HEADERS, derive_flows, derive_scored, feature_code, read_table, wide_sql,
)

QUERIES = {}
ORACLE = {}
SESSIONS = ["s1", "s2", "s3", "s4"]


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _headers(session: str) -> dict[str, str]:
    """Columns of an exported session and their headers; sessions differ in spelling and order."""
    ids = {"flow_seq": "Flow ID", "src_ip": "Source IP", "dst_ip": " Destination IP", "src_port": "Src Port", "protocol": "Protocol", "timestamp": "Timestamp"}
    features = {feature_code(i): SIGNATURE_HEADERS.get(n, n) if session in ("s2", "s4") else n for i, n in enumerate(FLOW_FEATURES)}
    if session in ("s3", "s4"):
        features = dict(reversed(features.items()))
    return {**features, **ids, "label": " Label"} if session == "s2" else {**ids, **features, "label": "Label"}


def export_flows(spark: SparkSession, d: str) -> str:
    """A CSV export per session, with all 77 features."""
    compile_in_parts(spark)
    target = folder(spark)
    flows = derive_flows(spark, d).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    sinks.write_by_session(flows, f"{target}-flows")
    stored = spark.read.schema(flows.schema).parquet(f"{target}-flows")
    headers = {s: _headers(s) for s in SESSIONS}
    sinks.write_session_csv(stored, target, SESSIONS, "flow_seq", headers, lambda own: spark.sql(wide_sql("{flows}"), flows=own))
    return target


def _numbers(names: list[str]) -> list[str]:
    return list(match_features(names).values())


def read_export(spark: SparkSession, target: str) -> DataFrame:
    """Aligned features of all sessions, with ids by role, the label, and the source order."""
    parts = []
    for rank, session in enumerate(SESSIONS):
        raw = drop_repeated_headers(ff.read_sessions(spark, target, [f"{session}.csv"], _numbers))
        roles = find_id_columns(raw.columns)
        named = raw.withColumnsRenamed({column: role for role, column in roles.items()})
        label = find_label_column(raw.columns)
        keep = ["session_id", "flow_seq", *roles, "Protocol", label]
        own = align_features(named, keep).withColumnsRenamed({label: "label", "Protocol": "protocol"})
        parts.append(own.withColumn("session_rank", F.lit(rank)))
    return reduce(lambda a, b: a.unionByName(b), parts)


_WEIGHTS = tuple(tuple((((7 * c + 3 * i) % 5) - 2) / 4 for i in range(len(FLOW_FEATURES))) for c in range(len(STATE_CLASSES)))
MODEL = LinearModel(_WEIGHTS, (0.5, 0.25, 0.0, -0.25))
SCALER = splits.MinMaxModel({f: 0.0 for f in FLOW_FEATURES}, {f: 100.0 + i for i, f in enumerate(FLOW_FEATURES)}, 1)


def number_sql(value: float) -> str:
    text = repr(float(value))
    return text if "e" in text else f"{text}E0"


def _logit(c: int) -> str:
    terms = [f"{number_sql(MODEL.coefficients[c][i])} * (x{i} * {number_sql(1.0 / (100.0 + i))})" for i in range(len(FLOW_FEATURES))]
    # The order of the operator: each input times its weight, added to the intercept from the left.
    return " + ".join([number_sql(MODEL.intercepts[c]), *[f"({t})" for t in terms]])


_CLEAN = ", ".join(f"CASE WHEN isfinite({feature_code(i)}) THEN {feature_code(i)} ELSE 0 END AS x{i}" for i in range(len(FLOW_FEATURES)))
_VALID = " AND ".join(f"isfinite({feature_code(i)})" for i in range(len(FLOW_FEATURES)))
LABELLED = (
    FLOWS.replace("flows AS", "raw AS", 1), f"wide AS ({wide_sql('raw')})",
    f"cleaned AS (SELECT *, {_VALID} AS valid, {_CLEAN} FROM wide)",
    "logits AS (SELECT *, " + ", ".join(f"{_logit(c)} AS z{c}" for c in range(4)) + " FROM cleaned)",
    """judged AS (SELECT flow_seq, CASE WHEN NOT valid THEN 'INVALID_FEATURES' WHEN z0 = m THEN 'BENIGN' WHEN z1 = m THEN 'DDoS' WHEN z2 = m THEN 'DoS' ELSE 'PortScan' END AS state,
  CASE WHEN valid THEN round(1 / (exp(z0 - m) + exp(z1 - m) + exp(z2 - m) + exp(z3 - m)), 4) END AS confidence FROM (SELECT *, greatest(z0, z1, z2, z3) AS m FROM logits))""",
    """flows AS (SELECT r.* REPLACE (CASE WHEN isinf(flow_pkts_s) THEN 0 ELSE flow_pkts_s END AS flow_pkts_s, j.state AS current_state), j.confidence,
  row_number() OVER (ORDER BY session_id, flow_seq) AS source_row FROM raw r JOIN judged j USING (flow_seq))""",
    EVIDENCE, SWEEPS.format(ports=30), SIGNED,
)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled flows of the CSV export, written and read again."""
    target = export_flows(spark, d)
    flows = read_export(spark, target).withColumnsRenamed(SIGNATURE_HEADERS)
    named = [SIGNATURE_HEADERS.get(f, f) for f in FLOW_FEATURES]
    scaler = splits.MinMaxModel(dict(zip(named, SCALER.minimum.values())), dict(zip(named, SCALER.maximum.values())), 1)
    other = [f for f in named if f not in SIGNATURE_HEADERS.values()]
    labelled = label_flows(flows, MODEL, scaler, named, {"flood": FLOOD, "syn": SYN, "sweep": SWEEP}, drop=other)
    sinks.write_labelled_flows(labelled, f"{target}/labelled")
    return spark.read.parquet(f"{target}/labelled")


@query(
    with_ctes(*LABELLED)
    + "SELECT flow_seq AS flow_id, session_id, source_row, label, current_state, confidence, signature_state, effective_state FROM effective"
)
def csv_label_flows(spark: SparkSession, d: str) -> DataFrame:
    """Exports of four sessions with different headers: aligned, scored, signed, written, read, and numbered in source order."""
    placed = with_position(_labelled(spark, d), [], "flow_seq", position="source_row", lead=["session_rank"])
    return placed.select(
        F.col("flow_id").cast("long").alias("flow_id"), "session_id", "source_row", "label", "current_state", "confidence",
        "signature_state", "effective_state",
    )


def _confirmed(source: str, column: str, name: str) -> str:
    text = _verdict_sql(source, column).replace("own >= 0.2E0", "(own >= 0.2E0 OR top = (SELECT attack_class FROM fired))")
    return f"SELECT *, '{name}' AS source FROM (WITH {text})"


@query(
    with_ctes(*LABELLED, """fired AS (SELECT CASE WHEN count(*) FILTER (WHERE signature_state = 'DDoS') > 0 THEN 'DDoS' WHEN count(*) FILTER (WHERE signature_state = 'DoS') > 0 THEN 'DoS'
  WHEN count(*) FILTER (WHERE signature_state = 'PortScan') > 0 THEN 'PortScan' END AS attack_class FROM signed)""")
    + _confirmed("effective", "current_state", "model") + " UNION ALL " + _confirmed("effective", "effective_state", "effective")
)
def csv_capture_report(spark: SparkSession, d: str) -> DataFrame:
    return capture_report(_labelled(spark, d))


@query(
    with_ctes(FLOWS, f"wide AS ({wide_sql('flows')})")
    + " UNION ALL ".join(
        f"SELECT session_id, '{f}' AS feature, count(*) AS n, count(*) FILTER (WHERE isfinite({feature_code(i)})) AS n_finite, "
        f"round(sum({feature_code(i)}) FILTER (WHERE isfinite({feature_code(i)})), 3) AS total FROM wide GROUP BY 1"
        for i, f in enumerate(FLOW_FEATURES)
    )
)
def csv_aligned_features(spark: SparkSession, d: str) -> DataFrame:
    """Sum of each of the 77 aligned features per session."""
    flows = read_export(spark, export_flows(spark, d))
    sums = [
        F.struct(F.lit(f).alias("feature"), F.count(F.lit(1)).alias("n"), F.count(quoted(f)).alias("n_finite"), F.round(F.sum(F.col(quoted(f))), 3).alias("total"))
        for f in FLOW_FEATURES
    ]
    return flows.groupBy("session_id").agg(F.array(*sums).alias("s")).select("session_id", F.inline("s"))


@query(with_ctes(FLOWS) + "SELECT session_id, count(*) AS rows, count(DISTINCT dst_port) AS ports FROM flows WHERE session_id IN ('s1', 's3') GROUP BY 1")
def csv_pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of two sessions."""
    target = export_flows(spark, d)
    rows = ff.read_sessions(spark, target, ["s1.csv", "s3.csv"]).select("session_id", F.col("` Destination Port`").alias("p"))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("p").alias("ports"))


@query(
    with_ctes(FLOWS)
    + """SELECT flow_seq % 50 = 0 AS malformed, count(*) AS rows, count(*) FILTER (WHERE label = 'DDoS') AS ddos_rows FROM flows GROUP BY 1"""
)
def csv_labelled_glob(spark: SparkSession, d: str) -> DataFrame:
    """Files of a glob with two headers and rows that are too long."""
    target = folder(spark)
    flows = derive_flows(spark, d).select("flow_seq", "label")
    text = F.concat_ws(",", "flow_seq", "label")
    left = F.when(F.col("flow_seq") % 50 == 0, F.concat(text, F.lit(",extra"))).otherwise(text)
    right = F.concat_ws(",", "label", "flow_seq")
    right = F.when(F.col("flow_seq") % 50 == 0, F.concat(right, F.lit(",extra"))).otherwise(right)
    for part, value, head in ((0, left, "Flow ID,Label"), (1, right, "Label,Flow ID")):
        own = flows.where(F.col("flow_seq") % 2 == part).select(value.alias(head))
        own.write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).csv(f"{target}/part{part}.csv")
    good, bad = ff.read_labelled(spark, f"{target}/*.csv")
    count = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("Label") == "DDoS").alias("ddos_rows")]
    return good.agg(F.lit(False).alias("malformed"), *count).unionByName(bad.agg(F.lit(True).alias("malformed"), *count))


@query(with_ctes(FLOWS) + "SELECT session_id, count(*) AS rows, FALSE AS derived, count(*) // 100 AS repeated FROM flows GROUP BY 1")
def csv_repeated_headers(spark: SparkSession, d: str) -> DataFrame:
    """Exports that repeat their header after every hundred rows of a session, and carry a derived column."""
    names = ["flow_seq", "session_id", "Protocol", "Current_State"]
    flows = derive_flows(spark, d).selectExpr("cast(flow_seq as string) AS flow_seq", "session_id", "cast(protocol as string) AS Protocol", "current_state AS Current_State")
    many = flows.groupBy("session_id").agg(F.floor(F.count(F.lit(1)) / 100).cast("int").alias("n")).where("n > 0")
    headers = many.select(F.explode(F.sequence(F.lit(1), F.col("n"))), "session_id").select(*[F.lit(c).alias(c) if c != "session_id" else F.col(c) for c in names])
    target = folder(spark)
    flows.unionByName(headers).write.option("header", True).csv(target)
    read = spark.read.option("header", True).csv(target)
    kept = drop_derived(drop_repeated_headers(read))
    before = read.groupBy("session_id").agg(F.count(F.lit(1)).alias("before"))
    after = kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.lit("Current_State" in kept.columns).alias("derived"))
    return after.join(before, "session_id").select("session_id", "rows", "derived", (F.col("before") - F.col("rows")).alias("repeated"))


@query(with_ctes(FLOWS) + "SELECT DISTINCT session_id, CAST(77 AS BIGINT) AS features, CAST(77 AS BIGINT) AS columns FROM flows")
def probed_headers(spark: SparkSession, d: str) -> DataFrame:
    """How many features, from how many columns, the header of each exported file names."""
    target = export_flows(spark, d)
    found = [(s, f, c) for s in SESSIONS for f, c in ff.probe_features(spark, f"{target}/{s}.csv").items()]
    named = spark.createDataFrame(found, "session_id string, feature string, name string")
    return named.groupBy("session_id").agg(F.count_distinct("feature").alias("features"), F.count_distinct("name").alias("columns"))


@query(with_ctes(FLOWS) + "SELECT count(*) AS rows, TRUE AS named, TRUE AS hashed FROM flows")
def file_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the exported files less one header each."""
    target = export_flows(spark, d)
    files = ff.fingerprints(spark, [f"{target}/{s}.csv" for s in SESSIONS])
    return files.agg(
        (F.sum("lines") - F.count(F.lit(1))).alias("rows"), F.bool_and(F.col("name").endswith(".csv")).alias("named"),
        F.bool_and((F.length("sha256") == 64) & F.col("line_digest").isNotNull()).alias("hashed"),
    )


@query(
    with_ctes(FLOWS, states())
    + f"SELECT session_id, window_id, {rounded_features()}, dominant_state FROM states WHERE session_id IN ('s2', 's3')"
)
def stored_windows(spark: SparkSession, d: str) -> DataFrame:
    """Window states written by session; two sessions read again."""
    target = folder(spark)
    sinks.write_by_session(window_states(derive_flows(spark, d), HOUR), target)
    return rounded(sinks.read_windows(spark, target, ["s2", "s3"])).select("session_id", "window_id", *STATE_FEATURES, "dominant_state")


@query(
    with_ctes(FLOWS, states(), NUMBERED, CHRONO, POSITIONAL.format(keys="session_id, split", source="(SELECT * EXCLUDE (pos, n) FROM ch)"))
    + "SELECT session_id, split, target_window_id, y_dominant_state FROM sq WHERE len(ids) = 5 AND target_window_id IS NOT NULL AND split <> 'train'"
)
def stored_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences written by split; two splits read again."""
    target = folder(spark)
    parts = splits.chronological_split(stage(window_states(derive_flows(spark, d), HOUR)))
    sinks.write_sequences(seq.sequences_positional(parts, within=["split"]), target)
    stored = spark.read.parquet(target).where("split in ('validation', 'test')")
    return stored.select("session_id", "split", "target_window_id", "y_dominant_state")


@query(with_ctes(FLOWS) + "SELECT CAST(count(*) AS VARCHAR) AS rows, CAST(count(DISTINCT session_id) AS VARCHAR) AS sessions, '3600' AS window_seconds FROM flows")
def stored_manifest(spark: SparkSession, d: str) -> DataFrame:
    target = folder(spark)
    counts = derive_flows(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("session_id").alias("sessions")).first()
    sinks.write_manifest(spark, {**counts.asDict(), "window_seconds": HOUR}, target)
    return spark.read.json(target)


@query(
    with_ctes(FLOWS)
    + " UNION ALL ".join(
        f"SELECT session_id, '{c}' AS \"column\", count({c}) AS non_null_values, round(min({c}), 6) AS numeric_min, round(max({c}), 6) AS numeric_max FROM flows GROUP BY 1"
        for c in ("flow_duration", "tot_fwd_pkts", "flow_iat_mean")
    )
)
def stored_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Column statistics written as CSV and read again."""
    target = folder(spark)
    sinks.write_column_statistics(profile.column_statistics(derive_flows(spark, d), ["flow_duration", "tot_fwd_pkts", "flow_iat_mean"]), target)
    schema = "session_id string, column string, non_null_values long, invalid_values long, numeric_min double, numeric_max double, is_constant boolean"
    return rounded(
        spark.read.schema(schema).option("header", True).csv(target).drop("invalid_values", "is_constant"), ["numeric_min", "numeric_max"]
    )


@query(with_ctes(FLOWS, states()) + "SELECT session_id, count(*) AS windows, TRUE AS from_cache, FALSE AS first_from_cache FROM states GROUP BY 1")
def cached_windows(spark: SparkSession, d: str) -> DataFrame:
    """Window states built once; the second call reads the finished entry."""
    target, identity = folder(spark), {"window_seconds": HOUR, "source": d}

    def build():
        return window_states(derive_flows(spark, d), HOUR)

    _, before = sinks.cached_table(spark, target, identity, build)
    table, hit = sinks.cached_table(spark, target, dict(reversed(identity.items())), build)
    counts = table.groupBy("session_id").agg(F.count(F.lit(1)).alias("windows"))
    return counts.withColumns({"from_cache": F.lit(hit), "first_from_cache": F.lit(before)})


@query(
    with_ctes(FLOWS, states(), NUMBERED, CHRONO, "r AS (SELECT min(flow_count) AS a, max(flow_count) AS b FROM ch WHERE split = 'train')")
    + "SELECT session_id, window_id, round((flow_count - a) / (b - a), 6) AS flow_count FROM ch, r"
)
def stored_scaler(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of the training windows, saved, loaded and applied."""
    target = folder(spark)
    parts = stage(splits.chronological_split(stage(window_states(derive_flows(spark, d), HOUR))))
    splits.fit_min_max(parts.where("split = 'train'")).save(spark, target)
    scaled = splits.MinMaxModel.load(spark, target).transform(parts)
    return rounded(scaled, ["flow_count"]).select("session_id", "window_id", "flow_count")


@query(with_ctes(FLOWS, states()) + "SELECT session_id, count(*) AS windows FROM states WHERE session_id = 's2' GROUP BY 1")
def recent_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Of three stored datasets, the newest one that is long enough."""
    target = folder(spark)
    whole = stage(window_states(derive_flows(spark, d), HOUR))
    whole.where("session_id = 's1'").write.parquet(f"{target}/old")
    whole.where("session_id = 's2'").write.parquet(f"{target}/middle")
    whole.where("session_id = 's3' and window_id < 3").write.parquet(f"{target}/new")
    ages = {f"{target}/old": 1, f"{target}/middle": 2, f"{target}/new": 3, f"{target}/none": 4}
    found = spark.read.parquet(sinks.recent_dataset(spark, ages, 5))
    return found.groupBy("session_id").agg(F.count(F.lit(1)).alias("windows"))


@query(
    with_ctes(FLOWS, states(600))
    + """SELECT window_id, CAST(flow_count AS BIGINT) AS flow_count, CAST(total_packets AS BIGINT) AS total_packets, CAST(attack_present AS BIGINT) AS attack_present FROM (
  SELECT *, row_number() OVER (ORDER BY window_id DESC) AS r FROM states WHERE session_id = 's1') WHERE r <= 500"""
)
def dashboard_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The last 500 ten-minute windows of a session."""
    shown = sinks.timeline(window_states(derive_flows(spark, d), 600).where("session_id = 's1'"))
    return shown.select("window_id", "flow_count", "total_packets", "attack_present")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_id * 7 END, -1) AS received, coalesce(CASE WHEN event_id % 5 IN (3, 4) THEN NULL ELSE event_id % 1000 END, -1) AS dropped FROM events")
def capture_logs(spark: SparkSession, d: str) -> DataFrame:
    """Packet counts from the logs of two capture tools."""
    n, lost = F.col("event_id") * 7, F.col("event_id") % 1000
    one = F.concat(F.lit("Capturing on 'eth0'\nPackets received/dropped on interface 'eth0': "), F.format_number(n, 0), F.lit("/"), lost, F.lit(" (99.9%)"))
    two = F.concat(n, F.lit(" packets received by filter\n"), lost, F.lit(" packets dropped by kernel\n"))
    three = F.concat(n, F.lit(" packet received by filter"))
    kind = F.col("event_id") % 5
    text = F.when(kind < 2, one).when(kind == 2, two).when(kind == 3, three).otherwise(F.lit("no counts"))
    received, dropped = capture_log_counts(text)
    return read_table(spark, d, "events").select(
        "event_id", F.coalesce(received, F.lit(-1)).alias("received"), F.coalesce(dropped, F.lit(-1)).alias("dropped")
    )


@query(
    """SELECT event_id, CASE event_id % 7 WHEN 6 THEN NULL WHEN 3 THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') WHEN 5 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f')
  ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') END AS parsed FROM events"""
)
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    """Times in six layouts: the month stands first unless that is impossible."""
    layouts = ["yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm", "yyyy/MM/dd HH:mm:ss", "M-d-yyyy"]
    kind = (F.col("event_id") % 7).cast("int")
    # After the twelfth of a month the day may stand first, too.
    swapped = F.when(F.dayofmonth("ts") > 12, F.date_format("ts", "d/M/yyyy H:mm:ss")).otherwise(F.date_format("ts", "M/d/yyyy H:mm:ss"))
    text = reduce(lambda rest, i: F.when(kind == i, F.date_format("ts", layouts[i])).otherwise(rest), range(6), F.lit("not-a-date"))
    text = F.when((kind == 1) & (F.col("event_id") % 2 == 0), swapped).otherwise(text)
    parsed = parse_timestamps(read_table(spark, d, "events").select("event_id", text.alias("text")), "text", "parsed")
    return parsed.select("event_id", time_text("parsed").alias("parsed"))


@query("SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM events")
def parsed_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds since the epoch as text."""
    events = read_table(spark, d, "events").select("event_id", F.unix_millis("ts").cast("string").alias("text"))
    return parse_timestamps(events, "text", "parsed").select("event_id", time_text("parsed").alias("parsed"))


@query(
    with_ctes(FLOWS)
    + "SELECT session_id, flow_seq, row_number() OVER (PARTITION BY session_id ORDER BY date_trunc('hour', timestamp), flow_seq % 17 * 100000000 + flow_seq) AS place FROM flows"
)
def chronological_order(spark: SparkSession, d: str) -> DataFrame:
    """Stable order by hour; flows of an hour stay in source order."""
    flows = derive_flows(spark, d).withColumns({"hour": F.date_trunc("hour", "timestamp"), "source_row": F.expr("flow_seq % 17 * 100000000 + flow_seq")})
    return chronological_position(flows, "hour", "source_row").select("session_id", "flow_seq", "place")


@query(
    with_ctes(FLOWS, SCORED)
    + """SELECT f.session_id, f.flow_seq, f.current_state AS y_pred, s.y_true FROM flows f JOIN scored s ON s.session_id = f.session_id AND s.flow_seq = f.flow_seq
  WHERE f.current_state IN ('BENIGN', 'DDoS', 'DoS', 'PortScan')"""
)
def joined_truth(spark: SparkSession, d: str) -> DataFrame:
    """Truth and predictions of two tables, by session and row."""
    predictions = derive_flows(spark, d).select("session_id", "flow_seq", F.col("current_state").alias("y_pred"))
    truth = derive_scored(spark, d).select("session_id", "flow_seq", "y_true")
    return join_predictions(truth, predictions)


@query("""SELECT event_id, 'c_' || (event_id % 1000) || '.pcap' AS name FROM events""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """File names of uploads."""
    path = F.concat(F.lit("/up/load*/c?"), F.col("event_id") % 1000, F.lit(".pcap"))
    return read_table(spark, d, "events").select("event_id", safe_file_name(path).alias("name"))
