"""Registered queries: windows, transitions, sequences and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.catalog.shaping import HOUR, joined, long, rounded, time_text
from netstate.catalog.sql import FLOWS, TRAINING_STATE, proxy_states, rounded_features, states, with_ctes
from netstate.constants import STATE_FEATURES
from netstate.functions.labels import evaluation_state, training_state, training_state_or_invalid
from netstate.operators import sequences as seq
from netstate.operators import splits, transitions
from netstate.operators.states import proxy_windows, state_totals, window_states
from netstate.scale import stage
from netstate.sources.tables import derive_flows

QUERIES = {}
ORACLE = {}
START_TEXT = "strftime(make_timestamp(start_us), '%Y-%m-%d %H:%M:%S.%f')"
GAP = "window_id % 13 <> 0"
COUNTS = ["benign_flow_count", "ddos_flow_count", "dos_flow_count", "portscan_flow_count"]


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Window states written once, for queries that read them more than once."""
    return stage(window_states(derive_flows(spark, d), HOUR))


@query(
    with_ctes(FLOWS, states())
    + f"""SELECT session_id, window_id, {START_TEXT} AS window_start, {rounded_features()},
  {", ".join(COUNTS)}, dominant_state, attack_present, alert_state FROM states"""
)
def window_state_vectors(spark: SparkSession, d: str) -> DataFrame:
    out = window_states(derive_flows(spark, d), HOUR)
    return rounded(out.withColumn("window_start", time_text("window_start")).drop("window_end"))


@query(
    with_ctes(FLOWS, proxy_states())
    + f"""SELECT session_id, window_id, {rounded_features()}, scoreable_flow_count, {", ".join(COUNTS)}, dominant_state,
  attack_present, alert_state, window_id * 10 AS proxy_start_row, window_id * 10 + 10 AS proxy_end_row FROM proxy"""
)
def proxy_state_vectors(spark: SparkSession, d: str) -> DataFrame:
    out = proxy_windows(derive_flows(spark, d), training_state_or_invalid(F.col("label")))
    return rounded(out.withColumn("scoreable_flow_count", F.col("scoreable_flow_count").cast("long")))


@query(
    with_ctes(FLOWS)
    + """SELECT state, count(*) AS flows FROM (SELECT coalesce(CASE
  WHEN l IN ('benign') THEN 'BENIGN' WHEN l = 'ddos' THEN 'DDoS'
  WHEN l IN ('dos hulk', 'dos goldeneye', 'dos slowloris', 'dos slowhttptest', 'heartbleed') THEN 'DoS'
  WHEN l = 'portscan' THEN 'PortScan' WHEN starts_with(l, 'dos ') THEN 'DoS' WHEN contains(l, 'ddos') THEN 'DDoS' END, 'NONE') AS state
  FROM (SELECT lower(trim(label)) AS l FROM flows)) GROUP BY 1"""
)
def evaluation_labels(spark: SparkSession, d: str) -> DataFrame:
    state = F.coalesce(evaluation_state(F.col("label")), F.lit("NONE"))
    return derive_flows(spark, d).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("flows"))


@query(
    with_ctes(FLOWS)
    + f"""SELECT coalesce({TRAINING_STATE}, 'NONE') AS state, count(*) AS flows
  FROM (SELECT lower(trim(label)) AS l FROM flows) GROUP BY 1"""
)
def training_labels(spark: SparkSession, d: str) -> DataFrame:
    state = F.coalesce(training_state(F.col("label")), F.lit("NONE"))
    return derive_flows(spark, d).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("flows"))


@query(
    with_ctes(FLOWS, states())
    + """SELECT state, CAST(n AS BIGINT) AS flow_count FROM (SELECT sum(benign_flow_count) AS "BENIGN", sum(ddos_flow_count) AS "DDoS",
  sum(dos_flow_count) AS "DoS", sum(portscan_flow_count) AS "PortScan" FROM states) UNPIVOT (n FOR state IN ("BENIGN", "DDoS", "DoS", "PortScan"))"""
)
def state_distribution(spark: SparkSession, d: str) -> DataFrame:
    return state_totals(window_states(derive_flows(spark, d), HOUR))


TRANSITIONS = """tr AS (SELECT session_id, window_id AS current_window, lead(window_id) OVER o AS next_window,
  dominant_state AS current_state, lead(dominant_state) OVER o AS next_state, attack_present AS current_attack_present,
  lead(attack_present) OVER o AS next_attack_present, (lead(start_us) OVER o - start_us) / 1000000 AS time_delta_seconds
  FROM states WINDOW o AS (PARTITION BY session_id ORDER BY window_id))"""


@query(with_ctes(FLOWS, states(where=GAP), TRANSITIONS) + "SELECT * FROM tr WHERE next_window IS NOT NULL")
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    return transitions.transitions(_states(spark, d).where(GAP), bits=5)


@query(
    with_ctes(FLOWS, states(), TRANSITIONS)
    + """SELECT current_state, next_state, count(*) AS transitions FROM tr WHERE next_window IS NOT NULL
  GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20"""
)
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    return transitions.transition_counts(transitions.transitions(_states(spark, d)))


@query(
    with_ctes(FLOWS, states(where=GAP))
    + """SELECT session_id, min(window_id) AS start_window, max(window_id) AS end_window, count(*) AS windows
  FROM (SELECT session_id, window_id, window_id - row_number() OVER (PARTITION BY session_id ORDER BY window_id) AS g FROM states)
  GROUP BY session_id, g"""
)
def contiguous_blocks(spark: SparkSession, d: str) -> DataFrame:
    return transitions.contiguous_blocks(_states(spark, d).where(GAP), bits=5)


@query(
    with_ctes(FLOWS, proxy_states())
    + """SELECT session_id, dominant_state AS state, min(window_id) AS start_window, max(window_id) AS end_window, count(*) AS windows,
  min(window_id) * 10 AS proxy_start_seconds, (max(window_id) + 1) * 10 AS proxy_end_seconds
  FROM (SELECT session_id, dominant_state, window_id, window_id - row_number() OVER (PARTITION BY session_id, dominant_state ORDER BY window_id) AS g
        FROM proxy WHERE dominant_state <> 'BENIGN') GROUP BY session_id, dominant_state, g"""
)
def attack_runs(spark: SparkSession, d: str) -> DataFrame:
    windows = proxy_windows(derive_flows(spark, d), training_state_or_invalid(F.col("label")))
    return transitions.attack_runs(stage(windows.select("session_id", "window_id", "dominant_state")))


@query(
    with_ctes(FLOWS, states(where=GAP))
    + f"""SELECT session_id, count(*) AS total_windows, CAST(0 AS BIGINT) AS bad_duration_windows,
  CAST(coalesce(sum(window_id - p - 1), 0) AS BIGINT) AS missing_windows, CAST(count(*) - count(DISTINCT window_id) AS BIGINT) AS duplicate_window_ids,
  CAST(coalesce(sum(CAST(start_us - ps < {HOUR * 1000000} AS INT)), 0) AS BIGINT) AS overlapping_windows
  FROM (SELECT *, lag(window_id) OVER o AS p, lag(start_us) OVER o AS ps FROM states WINDOW o AS (PARTITION BY session_id ORDER BY window_id))
  GROUP BY session_id"""
)
def window_audit(spark: SparkSession, d: str) -> DataFrame:
    return transitions.window_audit(_states(spark, d).where(GAP), HOUR, bits=5)


SHUFFLED = "flow_seq % 17 * 100000000 + flow_seq"


@query(
    with_ctes(FLOWS)
    + f"""SELECT session_id, count(*) AS valid_rows, CAST(sum(CAST(coalesce(ts < p, FALSE) AS INT)) AS BIGINT) AS out_of_order_rows
  FROM (SELECT session_id, epoch_us(timestamp) AS ts, lag(epoch_us(timestamp)) OVER (PARTITION BY session_id ORDER BY {SHUFFLED}) AS p FROM flows)
  GROUP BY 1"""
)
def order_audit(spark: SparkSession, d: str) -> DataFrame:
    flows = derive_flows(spark, d).withColumn("source_row", F.expr(SHUFFLED))
    return transitions.order_audit(flows, "source_row", bits=10).select("session_id", *long("valid_rows", "out_of_order_rows"))


def _ids(alias: str) -> str:
    return f"array_to_string({alias}, ',')"


CHECKSUM = " + ".join(f"{f} * {i + 1}" for i, f in enumerate(STATE_FEATURES))
"""All 28 features of a window in one number."""


def _checksum(vector):
    return reduce(lambda a, b: a + b, [vector[i] * (i + 1) for i in range(len(STATE_FEATURES))])


POSITIONAL = """placed AS (SELECT *, """ + CHECKSUM + """ AS total, row_number() OVER (PARTITION BY {keys} ORDER BY window_id) AS pos FROM {source}),
sq AS (SELECT {keys}, list(window_id) OVER o AS ids, list(flow_count) OVER o AS fc, list(total) OVER o AS cs, lead(total) OVER t AS y_total, lead(window_id) OVER t AS target_window_id,
  lead(dominant_state) OVER t AS y_dominant_state, lead(attack_present) OVER t AS y_attack_present, lead(total_packets) OVER t AS y_packets, pos, window_id
  FROM placed WINDOW o AS (PARTITION BY {keys} ORDER BY window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), t AS (PARTITION BY {keys} ORDER BY window_id))"""


@query(
    with_ctes(FLOWS, states(where=GAP), POSITIONAL.format(keys="session_id", source="states"))
    + f"""SELECT session_id, {_ids("ids")} AS input_window_ids, list_sum(fc) AS history_flows, round(list_sum(cs), 2) AS history_checksum, target_window_id, y_dominant_state, y_attack_present,
  y_packets, round(y_total, 2) AS target_checksum FROM sq WHERE len(ids) = 5 AND target_window_id IS NOT NULL"""
)
def sequences_positional(spark: SparkSession, d: str) -> DataFrame:
    out = seq.sequences_positional(_states(spark, d).where(GAP), bits=5)
    return out.select(
        "session_id", joined("input_window_ids").alias("input_window_ids"), _history_sum().alias("history_flows"),
        _history_checksum().alias("history_checksum"),
        "target_window_id", "y_dominant_state", "y_attack_present", F.col("y_state_vector")[7].alias("y_packets"),
        F.round(_checksum(F.col("y_state_vector")), 2).alias("target_checksum"),
    )


def _history_checksum():
    return F.round(F.aggregate("X", F.lit(0.0), lambda total, vector: total + _checksum(vector)), 2)


def _history_sum():
    """Sum of flow_count over the input windows."""
    return F.aggregate("X", F.lit(0.0), lambda total, vector: total + vector[0])


@query(
    with_ctes(FLOWS, states(where=GAP), POSITIONAL.format(keys="session_id", source="states"))
    + f"""SELECT session_id, {_ids("ids")} AS input_window_ids, list_sum(fc) AS history_flows, round(list_sum(cs), 2) AS history_checksum, target_window_id, y_dominant_state
  FROM sq WHERE len(ids) = 5 AND ids[1] = window_id - 4 AND target_window_id = window_id + 1"""
)
def sequences_gap_aware(spark: SparkSession, d: str) -> DataFrame:
    out = seq.sequences_gap_aware(window_states(derive_flows(spark, d), HOUR).where(GAP), bits=5)
    return out.select(
        "session_id", joined("input_window_ids").alias("input_window_ids"), _history_sum().alias("history_flows"),
        _history_checksum().alias("history_checksum"),
        "target_window_id", "y_dominant_state",
    )


MULTISTEP = """ms AS (SELECT session_id, window_id, list(window_id) OVER h AS hist, list(dominant_state) OVER h AS hl,
  list(window_id) OVER f AS fut, list(dominant_state) OVER f AS fl, list(alert_state) OVER f AS fa, list(flow_count) OVER h AS fc, list(""" + CHECKSUM + """) OVER h AS cs FROM {source}
  WINDOW h AS (PARTITION BY session_id ORDER BY window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY session_id ORDER BY window_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
multi AS (SELECT session_id, session_id || ':' || hist[1] || ':' || fut[6] AS sample_id, hl, fl, fa, fc, cs, fut FROM ms
  WHERE len(hist) = 5 AND len(fut) = 6 AND hist[1] = window_id - 4 AND fut[6] = window_id + 6)"""


@query(
    with_ctes(FLOWS, states(where=GAP), MULTISTEP.format(source="states"))
    + """SELECT session_id, sample_id, array_to_string(hl, ',') AS input_labels, array_to_string(fl, ',') AS y_dominant,
  array_to_string(fa, ',') AS y_alert, list_sum(fc) AS history_flows, round(list_sum(cs), 2) AS history_checksum FROM multi"""
)
def multistep_sequences(spark: SparkSession, d: str) -> DataFrame:
    out = seq.multistep_sequences(window_states(derive_flows(spark, d), HOUR).where(GAP), bits=5)
    return out.select(
        "session_id", "sample_id", joined("input_labels").alias("input_labels"), joined("y_dominant").alias("y_dominant"),
        joined("y_alert").alias("y_alert"), _history_sum().alias("history_flows"),
        _history_checksum().alias("history_checksum"),
    )


@query(
    with_ctes(FLOWS, states(where=GAP), POSITIONAL.format(keys="session_id", source="states"))
    + """SELECT session_id, target_window_id, CAST(CASE y_dominant_state WHEN 'BENIGN' THEN 0 WHEN 'DDoS' THEN 1 WHEN 'DoS' THEN 2 ELSE 3 END AS INT) AS y_class,
  y_packets, round(y_total, 2) AS target_checksum FROM sq WHERE len(ids) = 5 AND ids[1] = window_id - 4 AND target_window_id = window_id + 1"""
)
def next_state_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = seq.next_state_pairs(window_states(derive_flows(spark, d), HOUR).where(GAP), bits=5)
    return out.select("session_id", "target_window_id", "y_class", F.col("y_state")[7].alias("y_packets"), F.round(_checksum(F.col("y_state")), 2).alias("target_checksum"))


@query(
    with_ctes(FLOWS, states())
    + """SELECT session_id, window_id, dominant_state FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_id DESC) AS r,
  max(window_id) OVER (PARTITION BY session_id) AS m FROM states) WHERE r <= 5 AND m - window_id = r - 1"""
)
def recent_windows(spark: SparkSession, d: str) -> DataFrame:
    out = seq.recent_windows(window_states(derive_flows(spark, d), HOUR))
    return out.select("session_id", "window_id", "dominant_state")


NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_id) AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM states)"
CHRONO = """ch AS (SELECT *, CASE WHEN pos <= round_even(n * 0.7E0, 0) THEN 'train'
  WHEN pos <= round_even(n * 0.7E0, 0) + round_even(n * 0.15E0, 0) THEN 'validation' ELSE 'test' END AS split FROM n)"""


@query(with_ctes(FLOWS, states(), NUMBERED, CHRONO) + "SELECT session_id, window_id, split FROM ch")
def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.chronological_split(_states(spark, d), bits=5).select("session_id", "window_id", "split")


@query(
    with_ctes(FLOWS, states(), NUMBERED, CHRONO)
    + """SELECT session_id, split, count(*) AS n_windows, min(window_id) AS first_window, max(window_id) AS last_window FROM ch GROUP BY 1, 2"""
)
def split_bounds(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_bounds(splits.chronological_split(_states(spark, d)))


@query(
    with_ctes(
        FLOWS, states(), NUMBERED, CHRONO,
        POSITIONAL.format(keys="session_id, split", source="(SELECT * EXCLUDE (pos, n) FROM ch)"),
    )
    + f"""SELECT session_id, split, {_ids("ids")} AS input_window_ids, target_window_id FROM sq WHERE len(ids) = 5 AND target_window_id IS NOT NULL"""
)
def split_sequences(spark: SparkSession, d: str) -> DataFrame:
    parts = splits.chronological_split(_states(spark, d))
    out = seq.sequences_positional(parts, within=["split"], features=["flow_count"], bits=5)
    return out.select("session_id", "split", joined("input_window_ids").alias("input_window_ids"), "target_window_id")


@query(
    with_ctes(FLOWS, states(), NUMBERED)
    + """SELECT session_id, window_id, CASE WHEN pos <= c THEN 'train' ELSE 'holdout' END AS split
  FROM (SELECT *, least(greatest(6, CAST(floor(n * 0.85E0) AS BIGINT)), n) AS c FROM n) WHERE pos <= c OR pos > c + 5"""
)
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.holdout_split(_states(spark, d)).select("session_id", "window_id", "split")


@query(
    with_ctes(FLOWS, states(), NUMBERED)
    + """SELECT session_id, window_id, CASE WHEN pos <= greatest(6, CAST(floor(n * 0.9E0) AS BIGINT)) THEN 'train' ELSE 'validation' END AS split FROM n"""
)
def development_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.development_split(_states(spark, d)).select("session_id", "window_id", "split")


_EDGES = [f"{edge!r}E0" for edge in splits.fold_edges()]


@query(
    with_ctes(FLOWS, states(), NUMBERED)
    + f"""SELECT session_id, window_id, fold, CASE WHEN pos <= te THEN 'train' ELSE 'validation' END AS role FROM (
  SELECT *, least(greatest(te + 6, CAST(floor(n * hi) AS BIGINT)), n) AS ve FROM (
    SELECT *, greatest(6, CAST(floor(n * lo) AS BIGINT)) AS te FROM n,
      (VALUES (1, {_EDGES[0]}, {_EDGES[1]}), (2, {_EDGES[1]}, {_EDGES[2]}), (3, {_EDGES[2]}, {_EDGES[3]})) f(fold, lo, hi) WHERE n >= 24))
  WHERE ve - te - 5 > 5 AND (pos <= te OR (pos > te + 5 AND pos <= ve))"""
)
def rolling_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.rolling_folds(_states(spark, d)).select("session_id", "window_id", "fold", "role")


BUCKETS = {"s1.csv": "train", "s2.csv": "train", "s3.csv": "validation", "s4.csv": "test"}


@query(
    with_ctes(FLOWS, states(), NUMBERED)
    + """SELECT session_id, window_id, split FROM (SELECT *, CASE WHEN session_id IN ('s1', 's2') THEN 'train' WHEN session_id = 's3' THEN 'validation'
  WHEN pos <= CAST(floor(n * 0.6E0) AS BIGINT) THEN 'train'
  WHEN pos > CAST(floor(n * 0.6E0) AS BIGINT) + 6 AND pos <= CAST(floor(n * 0.8E0) AS BIGINT) THEN 'validation'
  WHEN pos > CAST(floor(n * 0.8E0) AS BIGINT) + 6 THEN 'test' END AS split FROM n) WHERE split IS NOT NULL"""
)
def embargo_split(spark: SparkSession, d: str) -> DataFrame:
    out = splits.embargo_split(_states(spark, d), BUCKETS, "s4")
    return out.select("session_id", "window_id", "split")


@query(
    with_ctes(FLOWS, states(), NUMBERED, CHRONO,
              "r AS (SELECT min(flow_count) AS a, max(flow_count) AS b, min(urg_count) AS c, max(urg_count) AS d, min(max_iat) AS e, max(max_iat) AS f FROM ch WHERE split = 'train')")
    + """SELECT session_id, window_id, round((flow_count - a) / (b - a), 6) AS flow_count, urg_count - c AS urg_count,
  round((max_iat - e) / (f - e), 6) AS max_iat FROM ch, r"""
)
def scaled_states(spark: SparkSession, d: str) -> DataFrame:
    parts = stage(splits.chronological_split(_states(spark, d)))
    scaler = splits.fit_min_max(parts.where(F.col("split") == "train"), STATE_FEATURES)
    scaled = rounded(scaler.transform(parts), ["flow_count", "max_iat"])
    return scaled.select("session_id", "window_id", "flow_count", "urg_count", "max_iat")


@query(
    with_ctes(FLOWS)
    + """SELECT flow_seq, current_state FROM (SELECT *, row_number() OVER (PARTITION BY current_state ORDER BY flow_seq) AS r FROM flows) WHERE r <= 250"""
)
def first_rows_per_class(spark: SparkSession, d: str) -> DataFrame:
    flows = derive_flows(spark, d).select("flow_seq", "current_state")
    return splits.first_per_class(flows, 250, "current_state", "flow_seq", bits=10)


@query(
    with_ctes(FLOWS)
    + """SELECT flow_seq, CASE WHEN r <= greatest(1, CAST(floor(n * 0.8E0) AS BIGINT)) THEN 'train' ELSE 'validation' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY current_state ORDER BY flow_seq) AS r, count(*) OVER (PARTITION BY current_state) AS n FROM flows)"""
)
def split_within_class(spark: SparkSession, d: str) -> DataFrame:
    flows = derive_flows(spark, d).select("flow_seq", "current_state")
    return splits.split_within_class(flows, "current_state", "flow_seq", bits=10).select("flow_seq", "split")
