"""Registered queries: profiles, quality gates and leakage audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.catalog.shaping import HOUR, long, rounded
from netstate.catalog.sql import FLOWS, states, with_ctes
from netstate.catalog.windows import CHRONO, MULTISTEP, NUMBERED, POSITIONAL, TRANSITIONS
from netstate.constants import STATE_FEATURES
from netstate.operators import audits, profile, splits, transitions
from netstate.operators import sequences as seq
from netstate.operators.states import assign_windows, window_states
from netstate.plans.digests import sample_digest
from netstate.scale import stage
from netstate.sources.tables import derive_flows

QUERIES = {}
ORACLE = {}
FLOW_FIELDS = [
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_duration", "tot_fwd_pkts", "totlen_fwd_pkts",
    "flow_pkts_s", "urg_flag_cnt", "label",
]


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _states(spark: SparkSession, d: str) -> DataFrame:
    return stage(window_states(derive_flows(spark, d), HOUR))


@query(
    with_ctes(FLOWS)
    + """SELECT session_id, count(*) AS rows, CAST(11 AS INT) AS columns, CAST(sum(CAST(isinf(flow_pkts_s) AS INT)) AS BIGINT) AS invalid_values,
  count(*) - count(DISTINCT (src_ip, dst_ip, src_port, dst_port, protocol, flow_duration, tot_fwd_pkts, totlen_fwd_pkts, flow_pkts_s, urg_flag_cnt, label)) AS duplicate_rows FROM flows GROUP BY 1"""
)
def source_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.source_profile(derive_flows(spark, d).select("session_id", *FLOW_FIELDS), order=None)


@query(
    with_ctes(FLOWS, "g AS (SELECT * EXCLUDE (flow_seq), count(*) AS n, sum(CAST(isinf(flow_pkts_s) AS INT)) AS bad FROM flows GROUP BY ALL)")
    + """SELECT CAST(count(DISTINCT session_id) AS INT) AS source_count, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(bad) AS BIGINT) AS invalid_values, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows_within_sessions FROM g"""
)
def combined_profile(spark: SparkSession, d: str) -> DataFrame:
    out = profile.combined_profile(profile.source_profile(derive_flows(spark, d)))
    return out.withColumn("source_count", F.col("source_count").cast("int"))


def _column_sql(name: str, numeric: bool = True) -> str:
    finite = f"CASE WHEN isfinite(CAST({name} AS DOUBLE)) THEN CAST({name} AS DOUBLE) END" if numeric else "CAST(NULL AS DOUBLE)"
    bad = f"count(*) FILTER (WHERE {name} IS NULL" + (f" OR isinf(CAST({name} AS DOUBLE)))" if numeric else ")")
    return f"""SELECT session_id, '{name}' AS "column", count({name}) AS non_null_values, {bad} AS invalid_values, min({finite}) AS numeric_min,
  max({finite}) AS numeric_max, count(DISTINCT {name}) <= 1 AS is_constant FROM flows GROUP BY 1"""


@query(with_ctes(FLOWS) + " UNION ALL ".join(_column_sql(c, c not in ("src_ip", "dst_ip", "label")) for c in FLOW_FIELDS))
def column_statistics(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_statistics(derive_flows(spark, d), FLOW_FIELDS)


@query(with_ctes(FLOWS) + "SELECT session_id, trim(label) AS label, count(*) AS rows FROM flows GROUP BY 1, 2")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.label_histogram(derive_flows(spark, d))


@query(
    with_ctes(FLOWS, 'v AS (SELECT \'label\' AS "column", label AS value FROM flows UNION ALL SELECT \'protocol\', CAST(protocol AS VARCHAR) FROM flows UNION ALL SELECT \'src_port\', CAST(src_port AS VARCHAR) FROM flows)',
              'k AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2)', 't AS (SELECT "column", count(*) AS "values", sum(n) AS total FROM k GROUP BY 1)')
    + """SELECT "column", value, "values", round(100.0E0 * n / total, 2) AS percent FROM k JOIN t USING ("column") WHERE "values" <= 100
  UNION ALL SELECT "column", NULL, "values", NULL FROM t WHERE "values" > 100"""
)
def category_shares(spark: SparkSession, d: str) -> DataFrame:
    return profile.category_shares(derive_flows(spark, d), ["label", "protocol", "src_port"])


@query(
    with_ctes(FLOWS)
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM flows"""
        for c in ("flow_duration", "tot_fwd_pkts", "syn_flag_cnt")
    )
)
def describe_flows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.describe(derive_flows(spark, d), ["flow_duration", "tot_fwd_pkts", "syn_flag_cnt"]), ["mean", "stddev"])


@query(
    with_ctes(FLOWS)
    + """SELECT session_id, count(*) AS rows, count(*) - count(DISTINCT (src_ip, dst_ip, protocol, label)) AS duplicate_rows FROM flows GROUP BY 1"""
)
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_rows(derive_flows(spark, d), ["src_ip", "dst_ip", "protocol", "label"])


def _label_counts() -> str:
    parts = []
    for c in ("BENIGN", "DDoS", "DoS", "PortScan"):
        parts.append(f"count(*) FILTER (WHERE current_state = '{c}') AS {c.lower()}_count")
        parts.append(f"round(100.0E0 * count(*) FILTER (WHERE current_state = '{c}') / count(current_state), 2) AS {c.lower()}_percent")
    return ", ".join(parts)


_LABEL_STATUS = """CASE WHEN count(*) FILTER (WHERE current_state NOT IN ('BENIGN', 'DDoS', 'DoS', 'PortScan')) > 0 OR count(*) FILTER (WHERE current_state IS NULL OR trim(current_state) = '') = count(current_state)
  THEN 'FAIL' WHEN count(*) FILTER (WHERE current_state IS NULL OR trim(current_state) = '') > 0 THEN 'WARNING' ELSE 'PASS' END"""
#: The flows without those that no model could score; some of them have lost their state.
SCORED_FLOWS = FLOWS.replace("flows AS", "_raw AS", 1) + """,
flows AS (SELECT * REPLACE (CASE WHEN flow_seq % 103 = 0 THEN NULL ELSE current_state END AS current_state) FROM _raw WHERE current_state <> 'INVALID_FEATURES')"""


@query(
    with_ctes(FLOWS)
    + f"""SELECT count(*) AS rows_checked, count(*) FILTER (WHERE current_state IS NULL OR trim(current_state) = '') AS missing_labels,
  count(*) FILTER (WHERE current_state NOT IN ('BENIGN', 'DDoS', 'DoS', 'PortScan')) AS unknown_label_count, {_label_counts()}, {_LABEL_STATUS} AS status FROM flows"""
)
def label_check(spark: SparkSession, d: str) -> DataFrame:
    return audits.label_check(derive_flows(spark, d))


@query(
    with_ctes(SCORED_FLOWS)
    + f"""SELECT count(*) AS rows_checked, count(*) FILTER (WHERE current_state IS NULL OR trim(current_state) = '') AS missing_labels,
  count(*) FILTER (WHERE current_state NOT IN ('BENIGN', 'DDoS', 'DoS', 'PortScan')) AS unknown_label_count, {_label_counts()}, {_LABEL_STATUS} AS status FROM flows"""
)
def label_check_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The same check where states are missing but none is unknown."""
    return audits.label_check(_gaps(spark, d))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    flows = derive_flows(spark, d).where("current_state <> 'INVALID_FEATURES'")
    return flows.withColumn("current_state", F.when(F.col("flow_seq") % 103 != 0, F.col("current_state")))


@query(with_ctes(FLOWS) + "SELECT DISTINCT current_state AS label FROM flows WHERE current_state NOT IN ('BENIGN', 'DDoS', 'DoS', 'PortScan')")
def unknown_labels(spark: SparkSession, d: str) -> DataFrame:
    return audits.unknown_labels(derive_flows(spark, d))


TIMED = "timed AS (SELECT session_id, flow_seq, CASE WHEN flow_seq % 101 = 0 THEN NULL ELSE epoch_us(date_trunc('hour', timestamp)) END AS us FROM flows)"


def _timed(spark: SparkSession, d: str) -> DataFrame:
    time = F.when(F.col("flow_seq") % 101 != 0, F.date_trunc("hour", "timestamp"))
    return derive_flows(spark, d).withColumn("timestamp", time)


@query(
    with_ctes(FLOWS, TIMED, "o AS (SELECT session_id, us < lag(us) OVER (PARTITION BY session_id ORDER BY flow_seq % 17 * 100000000 + flow_seq) AS bad FROM timed WHERE us IS NOT NULL)",
              "x AS (SELECT count(*) AS r, count(us) AS v, count(DISTINCT (session_id, us)) FILTER (WHERE us IS NOT NULL) AS k, (max(us) - min(us)) / 1000000 AS dur FROM timed)")
    + """SELECT r AS rows_checked, v AS valid_timestamps, r - v AS missing_or_invalid, v - k AS duplicate_timestamps, (SELECT count(*) FROM o WHERE bad) AS out_of_order_rows, dur AS duration_seconds,
  CASE WHEN v = 0 OR ((SELECT count(*) FROM o WHERE bad) > 5 AND (SELECT count(*) FROM o WHERE bad) > v * 0.05E0) THEN 'FAIL' WHEN r > v OR (SELECT count(*) FROM o WHERE bad) > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM x"""
)
def timestamp_check(spark: SparkSession, d: str) -> DataFrame:
    flows = _timed(spark, d).withColumn("source_row", F.expr("flow_seq % 17 * 100000000 + flow_seq"))
    return audits.timestamp_check(flows, order="source_row")


@query(
    with_ctes(FLOWS)
    + """SELECT CAST(count(*) - count(DISTINCT (session_id, src_ip, dst_port)) AS BIGINT) AS exact_duplicate_rows, CAST(count(*) - count(DISTINCT (session_id, timestamp)) AS BIGINT) AS duplicate_timestamps, CASE WHEN count(*) > count(DISTINCT (session_id, src_ip, dst_port)) THEN 'WARNING' ELSE 'PASS' END AS status FROM flows"""
)
def duplicate_check(spark: SparkSession, d: str) -> DataFrame:
    return audits.duplicate_check(derive_flows(spark, d), ["src_ip", "dst_port"])


@query(
    with_ctes(FLOWS)
    + """SELECT count(*) AS rows_checked, count(*) FILTER (WHERE flow_seq % 101 = 0) AS missing_timestamps, CAST(0 AS BIGINT) AS missing_current_state, CAST(0 AS BIGINT) AS nan_numeric_values,
  count(*) FILTER (WHERE isinf(flow_pkts_s)) AS infinite_values, CASE WHEN count(*) = 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE flow_seq % 101 = 0 OR isinf(flow_pkts_s)) > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM flows"""
)
def missing_check(spark: SparkSession, d: str) -> DataFrame:
    return audits.missing_check(_timed(spark, d))


@query(
    with_ctes(FLOWS, states())
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(0 AS BIGINT) AS nan, CAST(0 AS BIGINT) AS infinite, round(min({f}), 6) AS min, round(max({f}), 6) AS max, count(DISTINCT {f}) <= 1 AS constant, CASE WHEN min({f}) < -1 THEN 'FAIL' WHEN min({f}) < 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM states"
        for f in STATE_FEATURES
    )
)
def feature_health(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audits.feature_health(window_states(derive_flows(spark, d), HOUR)), ["min", "max"])


@query(
    with_ctes(FLOWS, states(), TRANSITIONS)
    + """SELECT count(*) AS total_transitions, count(*) FILTER (WHERE current_window % 7 = 3) AS invalid_current_window_refs, count(*) FILTER (WHERE next_window % 7 = 3) AS invalid_next_window_refs,
  CAST(0 AS BIGINT) AS invalid_state_labels, CAST(0 AS BIGINT) AS backward_time_transitions, count(*) FILTER (WHERE next_window % 7 = 3) AS consistency_mismatches,
  CASE WHEN count(*) FILTER (WHERE current_window % 7 = 3 OR next_window % 7 = 3) > 0 THEN 'FAIL' WHEN count(*) = 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM tr WHERE next_window IS NOT NULL"""
)
def transition_check(spark: SparkSession, d: str) -> DataFrame:
    whole = _states(spark, d)
    return audits.transition_check(whole.where("window_id % 7 <> 3"), transitions.transitions(whole))


@query(
    with_ctes(FLOWS, states(), POSITIONAL.format(keys="session_id", source="states"))
    + """SELECT count(*) AS total_sequences, CAST(0 AS BIGINT) AS target_misaligned, CAST(0 AS BIGINT) AS wrong_length, CAST(count(*) - count(DISTINCT fc) AS BIGINT) AS duplicate_sequences,
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT greatest(count(*) - 5, 0) AS n FROM states GROUP BY session_id)) AS expected_sequences,
  CASE WHEN count(*) > count(DISTINCT fc) THEN 'WARNING' ELSE 'PASS' END AS status FROM sq WHERE len(ids) = 5 AND target_window_id IS NOT NULL"""
)
def sequence_check(spark: SparkSession, d: str) -> DataFrame:
    whole = _states(spark, d)
    return audits.sequence_check(whole, seq.sequences_positional(whole, features=["flow_count"]))


SPLIT_SEQUENCES = (
    FLOWS, states(), NUMBERED, CHRONO,
    POSITIONAL.format(keys="session_id, split", source="(SELECT * EXCLUDE (pos, n) FROM ch)"),
    "sqs AS (SELECT * FROM sq WHERE len(ids) = 5 AND target_window_id IS NOT NULL)",
)


DISORDER = """dis AS (SELECT session_id FROM sqs GROUP BY 1 HAVING max(target_window_id) FILTER (WHERE split = 'train') >= min(target_window_id) FILTER (WHERE split = 'validation')
  OR max(target_window_id) FILTER (WHERE split = 'train') >= min(target_window_id) FILTER (WHERE split = 'test') OR max(target_window_id) FILTER (WHERE split = 'validation') >= min(target_window_id) FILTER (WHERE split = 'test'))"""


@query(
    with_ctes(*SPLIT_SEQUENCES, DISORDER)
    + """SELECT count(*) FILTER (WHERE split = 'train') AS train_sequences, count(*) FILTER (WHERE split = 'validation') AS validation_sequences, count(*) FILTER (WHERE split = 'test') AS test_sequences,
  (SELECT count(*) FROM dis) AS disordered_sessions, CASE WHEN (SELECT count(*) FROM dis) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM sqs"""
)
def split_order_check(spark: SparkSession, d: str) -> DataFrame:
    parts = splits.chronological_split(_states(spark, d))
    return audits.split_order_check(seq.sequences_positional(parts, within=["split"], features=["flow_count"]))


def _pair_sql() -> str:
    pairs = (("train", "validation"), ("train", "test"), ("validation", "test"))
    duplicate = ", ".join(
        f"(SELECT count(*) FROM (SELECT fc FROM sqs WHERE split = '{a}' INTERSECT SELECT fc FROM sqs WHERE split = '{b}')) AS duplicate_{a}_{b}" for a, b in pairs
    )
    overlap = ", ".join(
        f"(SELECT count(*) FROM sqs a WHERE split = '{a}' AND EXISTS (SELECT 1 FROM used u WHERE u.split = '{b}' AND u.session_id = a.session_id AND list_contains(a.ids, u.w))) AS overlap_{a}_{b}"
        for a, b in pairs
    )
    return f"SELECT {duplicate}, {overlap}"


@query(
    with_ctes(*SPLIT_SEQUENCES, "used AS (SELECT DISTINCT session_id, split, unnest(ids) AS w FROM sqs)")
    + f"SELECT *, CASE WHEN duplicate_train_validation + duplicate_train_test + duplicate_validation_test + overlap_train_validation + overlap_train_test + overlap_validation_test > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({_pair_sql()})"
)
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    parts = splits.chronological_split(_states(spark, d))
    return audits.leakage_check(seq.sequences_positional(parts, within=["split"], features=["flow_count"]))


LEAKY = "leaky AS (SELECT *, CASE WHEN window_id % 3 = 0 THEN 'validation' WHEN window_id % 3 = 1 THEN 'test' ELSE 'train' END AS split FROM sq WHERE len(ids) = 5 AND target_window_id IS NOT NULL), sqs AS (SELECT * FROM leaky)"


@query(
    with_ctes(FLOWS, states(), POSITIONAL.format(keys="session_id", source="states"), LEAKY, "used AS (SELECT DISTINCT session_id, split, unnest(ids) AS w FROM sqs)")
    + f"SELECT *, 'FAIL' AS status FROM ({_pair_sql()})"
)
def leakage_found(spark: SparkSession, d: str) -> DataFrame:
    """The same audit over an interleaved split, where every sequence leaks."""
    sequences = seq.sequences_positional(_states(spark, d), features=["flow_count"])
    last = F.element_at("input_window_ids", -1) % 3
    split = F.when(last == 0, "validation").when(last == 1, "test").otherwise("train")
    return audits.leakage_check(sequences.withColumn("split", split))


TEST_CUT = "least(greatest(6, CAST(floor(n * 0.85E0) AS BIGINT)), n)"
FINAL_SPLIT = f"""fs AS (SELECT *, CASE WHEN pos <= greatest(6, CAST(floor({TEST_CUT} * 0.9E0) AS BIGINT)) THEN 'train' WHEN pos <= {TEST_CUT} THEN 'validation' ELSE 'test' END AS split
  FROM n WHERE pos <= {TEST_CUT} OR pos > {TEST_CUT} + 5)"""
AUDITED = "au AS (SELECT * FROM sq WHERE len(ids) = 5 AND ids[1] = window_id - 4 AND target_window_id = window_id + 1)"


def _audit_sql() -> str:
    """Violations counted over the gap-aware sequences of the final split."""
    shared = """(SELECT count(*) FROM (SELECT session_id, target_window_id FROM au WHERE split = '{a}' INTERSECT SELECT session_id, target_window_id FROM au WHERE split = '{b}'))"""
    copies = " + ".join(
        f"(SELECT count(*) FROM (SELECT fc, pc FROM au WHERE split = '{a}' INTERSECT SELECT fc, pc FROM au WHERE split = '{b}'))"
        for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))
    )
    misaligned = "(SELECT count(*) FROM au WHERE target_window_id <> ids[5] + 1 OR ids[5] - ids[1] <> 4)"
    span = "FROM fs w WHERE w.session_id = a.session_id AND w.split = a.split AND w.window_id BETWEEN a.ids[1] AND a.target_window_id"
    foreign = f"(SELECT count(*) FROM au a WHERE (SELECT count(*) {span}) <> a.target_window_id - a.ids[1] + 1)"
    broken = f"(SELECT count(*) FROM au a WHERE (SELECT count(*) {span}) <> a.target_window_id - a.ids[1] + 1 OR (SELECT max(start_us) - min(start_us) {span}) <> (a.target_window_id - a.ids[1]) * 3600000000)"
    future = "(SELECT count(*) FROM au WHERE list_max(ids) >= target_window_id)"
    unlabelled = "(SELECT count(*) FROM au WHERE y_dominant_state NOT IN ('BENIGN', 'DDoS', 'DoS', 'PortScan'))"
    counts = {
        "session_boundary_leakage": foreign, "train_validation_overlap": shared.format(a="train", b="validation"),
        "train_test_overlap": shared.format(a="train", b="test"), "scaler_train_only": "0", "next_window_alignment": misaligned,
        "future_feature_leakage": future, "duplicate_sequence_leakage": copies, "invalid_features_exclusion": unlabelled,
        "synthetic_session_continuity": broken,
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", CAST({sql} AS BIGINT) AS violations" for name, sql in counts.items())


AUDIT_SEQUENCES = POSITIONAL.format(keys="session_id, split", source="(SELECT * EXCLUDE (pos, n) FROM fs)").replace(
    "list(flow_count) OVER o AS fc", "list(flow_count) OVER o AS fc, list(total_packets) OVER o AS pc"
)


@query(
    with_ctes(FLOWS, states(), NUMBERED, FINAL_SPLIT, AUDIT_SEQUENCES, AUDITED, f"v AS ({_audit_sql()})")
    + """SELECT "check", CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status, violations, 'counted' AS basis FROM v
  UNION ALL SELECT 'overall', CASE WHEN max(violations) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FILTER (WHERE violations > 0), 'counted' FROM v"""
)
def training_audit(spark: SparkSession, d: str) -> DataFrame:
    parts = stage(splits.final_split(_states(spark, d)))
    sequences = seq.sequences_gap_aware(parts, within=["split"])
    return audits.training_audit(sequences, splits.fit_min_max(parts.where(F.col("split") == "train")), parts)


@query(
    with_ctes(FLOWS, states())
    + """SELECT count(*) AS input_rows, count(timestamp) AS timestamps_valid, count(*) - count(timestamp) AS timestamps_invalid, (max(epoch_us(timestamp)) - min(epoch_us(timestamp))) / 1000000 AS span_seconds,
  (SELECT count(*) FROM states) AS total_windows, (SELECT count(*) - count(DISTINCT session_id) FROM states) AS transitions, (SELECT CAST(sum(benign_flow_count) AS BIGINT) FROM states) AS benign_flows,
  (SELECT CAST(sum(ddos_flow_count) AS BIGINT) FROM states) AS ddos_flows, (SELECT CAST(sum(dos_flow_count) AS BIGINT) FROM states) AS dos_flows, (SELECT CAST(sum(portscan_flow_count) AS BIGINT) FROM states) AS portscan_flows,
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT greatest(count(*) - 5, 0) AS n FROM states GROUP BY session_id)) AS total_sequences FROM flows"""
)
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    from netstate.plans import dataset

    whole = _states(spark, d)
    return dataset.dataset_summary(derive_flows(spark, d), whole, seq.sequences_positional(whole, features=["flow_count"]))


@query(
    with_ctes(FLOWS, states())
    + """SELECT f.session_id, flow_records, invalid_features, available_windows, CAST(401 AS INT) AS required_windows, span AS capture_seconds,
  printf('Insufficient temporal data: required windows 401, available windows %d, capture duration %.2f sec, flow records %d, invalid features %d, window size 3600 s, sequence length 400.', available_windows, span, flow_records, invalid_features) AS message
  FROM (SELECT session_id, count(*) AS flow_records, (max(epoch_us(timestamp)) - min(epoch_us(timestamp))) / 1000000 AS span,
  count(*) FILTER (WHERE current_state = 'INVALID_FEATURES') AS invalid_features FROM flows GROUP BY 1) f JOIN (SELECT session_id, count(*) AS available_windows FROM states GROUP BY 1) s USING (session_id) WHERE available_windows < 401"""
)
def insufficient_data(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that cannot serve sequences of 400 windows."""
    from netstate.plans import dataset

    out = dataset.insufficient_data(derive_flows(spark, d), _states(spark, d), 400, HOUR)
    return out.select(
        "session_id", "flow_records", "invalid_features", "available_windows", "required_windows", "capture_seconds", "message"
    )


@query(
    with_ctes(FLOWS, states(), MULTISTEP.format(source="states"), "t AS (SELECT CASE WHEN session_id = 's3' THEN 'validation' ELSE 'train' END AS split, unnest(fl) AS l FROM multi)")
    + """SELECT count(*) FILTER (WHERE split = 'train' AND l = 'BENIGN') AS train_benign, count(*) FILTER (WHERE split = 'train' AND l = 'DDoS') AS train_ddos, count(*) FILTER (WHERE split = 'train' AND l = 'DoS') AS train_dos,
  count(*) FILTER (WHERE split = 'train' AND l = 'PortScan') AS train_portscan, count(*) FILTER (WHERE split = 'validation' AND l = 'DDoS') AS validation_ddos,
  CASE WHEN least(train_benign, train_ddos, train_dos, train_portscan, validation_ddos) = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM t"""
)
def class_support_gate(spark: SparkSession, d: str) -> DataFrame:
    samples = seq.multistep_sequences(window_states(derive_flows(spark, d), HOUR), features=["flow_count"])
    split = F.when(F.col("session_id") == "s3", "validation").otherwise("train")
    return audits.class_support_gate(samples.withColumn("split", split))


@query(
    with_ctes(FLOWS, states(), "o AS (SELECT epoch_us(timestamp) < lag(epoch_us(timestamp)) OVER (PARTITION BY session_id ORDER BY epoch_us(timestamp), flow_seq) AS back FROM flows)",
        f"a AS (SELECT count(*) FILTER (WHERE epoch_us(timestamp) - t0 < window_id * {HOUR * 1000000} OR epoch_us(timestamp) - t0 >= (window_id + 1) * {HOUR * 1000000}) AS outside FROM _w)",
        f"l AS (SELECT count(*) FILTER (WHERE start_us - p < {HOUR * 1000000}) AS overlapping FROM (SELECT start_us, lag(start_us) OVER (PARTITION BY session_id ORDER BY window_id) AS p FROM states))",
        "u AS (SELECT count(*) FILTER (WHERE dominant_state NOT IN ('BENIGN', 'DDoS', 'DoS', 'PortScan')) AS unknown FROM states)",
        """g AS (SELECT 'timestamp_column_exists' AS gate, TRUE AS passed, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'timestamps_parseable', count(timestamp) > 0, count(timestamp) FROM flows
  UNION ALL SELECT 'chronological_order', count(*) FILTER (WHERE back) = 0, count(*) FILTER (WHERE back) FROM o UNION ALL SELECT 'window_assignment', outside = 0, outside FROM a
  UNION ALL SELECT 'no_future_leakage', overlapping = 0, overlapping FROM l UNION ALL SELECT 'state_features_numeric', TRUE, CAST(0 AS BIGINT) UNION ALL SELECT 'state_labels_valid', unknown = 0, unknown FROM u)""")
    + "SELECT * FROM g"
)
def build_gates(spark: SparkSession, d: str) -> DataFrame:
    flows = derive_flows(spark, d)
    return audits.build_gates(flows, assign_windows(flows, HOUR), _states(spark, d))


_DISTINCT = ", ".join(["session_id", *FLOW_FIELDS])
_LEAST = ", ".join(STATE_FEATURES)
VALIDATION = """ck AS (
  SELECT 'current_state' AS "check", CASE WHEN count(*) FILTER (WHERE current_state NOT IN ('BENIGN', 'DDoS', 'DoS', 'PortScan')) > 0 THEN 'FAIL' WHEN count(*) > count(current_state) THEN 'WARNING' ELSE 'PASS' END AS status FROM flows
  UNION ALL SELECT 'timestamps', CASE WHEN count(*) FILTER (WHERE back) > 5 AND count(*) FILTER (WHERE back) > count(*) * 0.05E0 THEN 'FAIL' WHEN count(*) FILTER (WHERE back) > 0 THEN 'WARNING' ELSE 'PASS' END
    FROM (SELECT epoch_us(timestamp) < lag(epoch_us(timestamp)) OVER (PARTITION BY session_id ORDER BY flow_seq) AS back FROM flows)
  UNION ALL SELECT 'duplicates', CASE WHEN count(*) > count(DISTINCT (""" + _DISTINCT + """)) THEN 'WARNING' ELSE 'PASS' END FROM flows
  UNION ALL SELECT 'missing_data', CASE WHEN count(*) FILTER (WHERE isinf(flow_pkts_s) OR timestamp IS NULL OR current_state IS NULL) > 0 THEN 'WARNING' ELSE 'PASS' END FROM flows
  UNION ALL SELECT 'windows', CASE WHEN sum(window_id - p - 1) > 0 THEN 'WARNING' ELSE 'PASS' END FROM (SELECT window_id, lag(window_id) OVER (PARTITION BY session_id ORDER BY window_id) AS p FROM states)
  UNION ALL SELECT 'features', CASE WHEN min(least(""" + _LEAST + """)) < -1 THEN 'FAIL' WHEN min(least(""" + _LEAST + """)) < 0 THEN 'WARNING' ELSE 'PASS' END FROM states
  UNION ALL SELECT 'transitions', CASE WHEN count(*) FILTER (WHERE next_window <= current_window) > 0 THEN 'FAIL' WHEN count(*) = 0 THEN 'WARNING' ELSE 'PASS' END FROM tr WHERE next_window IS NOT NULL
  UNION ALL SELECT 'sequences', CASE WHEN count(*) <> (SELECT sum(k) FROM (SELECT greatest(count(*) - 5, 0) AS k FROM states GROUP BY session_id)) OR count(*) > count(DISTINCT cs) THEN 'WARNING' ELSE 'PASS' END
    FROM (SELECT list(total) OVER o AS cs, lead(window_id) OVER (PARTITION BY session_id ORDER BY window_id) AS following, count(*) OVER o AS k FROM placed WINDOW o AS (PARTITION BY session_id ORDER BY window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE k = 5 AND following IS NOT NULL
  UNION ALL SELECT 'chronological_split', CASE WHEN count(*) FILTER (WHERE a >= b OR b2 >= c OR a >= c) > 0 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT session_id, max(target_window_id) FILTER (WHERE split = 'train') AS a,
    min(target_window_id) FILTER (WHERE split = 'validation') AS b, max(target_window_id) FILTER (WHERE split = 'validation') AS b2, min(target_window_id) FILTER (WHERE split = 'test') AS c FROM sqs GROUP BY 1)
  UNION ALL SELECT 'leakage', CASE WHEN (SELECT count(*) FROM (SELECT cs FROM sqs GROUP BY 1 HAVING count(DISTINCT split) > 1)) + (SELECT count(*) FROM (SELECT session_id, w FROM used GROUP BY 1, 2 HAVING count(*) > 1)) > 0 THEN 'FAIL' ELSE 'PASS' END
  UNION ALL SELECT 'label_leakage', 'PASS')"""


@query(
    with_ctes(*SPLIT_SEQUENCES, TRANSITIONS, "used AS (SELECT DISTINCT session_id, split, unnest(ids) AS w FROM sqs)", VALIDATION)
    + """SELECT * FROM ck UNION ALL SELECT 'overall', CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END FROM ck"""
)
def dataset_validation(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a prepared dataset and the overall status; the queries above show their counts."""
    from netstate.plans.dataset import validate_dataset

    flows = derive_flows(spark, d)
    whole = _states(spark, d)
    parts = stage(seq.sequences_positional(splits.chronological_split(whole), within=["split"]))
    return validate_dataset(
        flows, whole, transitions.transitions(whole), seq.sequences_positional(whole), parts, HOUR, FLOW_FIELDS
    ).select("check", "status")


@query(
    with_ctes(FLOWS, states(), "ids AS (SELECT session_id, session_id || ':' || window_id AS id, window_id FROM states)")
    + """SELECT session_id, count(*) AS samples, sha256(sha256(sha256(sha256(string_agg(id, chr(10) ORDER BY window_id))))) AS digest FROM ids GROUP BY 1"""
)
def sample_identity(spark: SparkSession, d: str) -> DataFrame:
    whole = window_states(derive_flows(spark, d), HOUR)
    ids = whole.withColumn("id", F.concat_ws(":", "session_id", "window_id"))
    return sample_digest(ids, "id", "window_id", ["session_id"])
