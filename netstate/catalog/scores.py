"""Registered queries: classification, ranking, calibration and horizon metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netstate.catalog.shaping import HOUR, rounded
from netstate.catalog.sql import FLOWS, SCORED, states, with_ctes
from netstate.catalog.windows import CHRONO, MULTISTEP, NUMBERED
from netstate.constants import STATE_CLASSES
from netstate.operators import horizons as hz
from netstate.operators import metrics as mt
from netstate.operators import sequences as seq
from netstate.operators import splits
from netstate.operators.audits import activation_gates as activation
from netstate.operators.audits import probability_sanity as probability_checks
from netstate.operators.audits import promotion_gates as gates
from netstate.operators.states import window_states
from netstate.plans.forecasting import rolling_session_diagnostics, select_weighting
from netstate.scale import stage, with_running_total
from netstate.sources.tables import derive_flows, derive_scored

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


CLASSES = "(VALUES ('BENIGN', 1), ('DDoS', 2), ('DoS', 3), ('PortScan', 4)) cls(c, ci)"


def class_ctes(source: str = "scored", keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    return f"""_m AS (SELECT {lead}c, count(*) FILTER (WHERE y_true = c AND y_pred = c) AS tp, count(*) FILTER (WHERE y_pred = c) AS np,
  count(*) FILTER (WHERE y_true = c) AS support FROM {source}, {CLASSES} GROUP BY {lead}c),
per_class AS (SELECT {lead}c AS class, coalesce(tp / nullif(np, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2.0E0 * tp / nullif(np + support, 0), 0) AS f1, support FROM _m)"""


def summary_select(keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}CAST(sum(support) AS BIGINT) AS samples, sum(recall * support) / sum(support) AS accuracy,
  avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
  sum(f1 * support) / sum(support) AS weighted_f1, CASE count(*) FILTER (WHERE support > 0 AND class <> 'BENIGN') WHEN 3 THEN 'sufficient_attack_support'
    WHEN 0 THEN 'benign_only_holdout' ELSE 'limited_attack_support' END AS evaluation_status FROM per_class {group}"""


SUMMARY = ["accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]
SUMMARY_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in SUMMARY)
RATIOS = ["precision", "recall", "f1", "false_positive_rate", "false_negative_rate"]


def attack_sql(source: str = "scored", keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}tp, tn, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
  CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN coalesce(2.0E0 * tp / nullif(2 * tp + fp + fn, 0), 0) END AS f1,
  fp / nullif(fp + tn, 0) AS false_positive_rate, fn / nullif(fn + tp, 0) AS false_negative_rate
  FROM (SELECT {lead}count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE NOT t AND p) AS fp,
    count(*) FILTER (WHERE t AND NOT p) AS fn FROM (SELECT *, y_true <> 'BENIGN' AS t, y_pred <> 'BENIGN' AS p FROM {source}) {group})"""


RATIO_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in RATIOS)


@query(
    with_ctes(FLOWS, SCORED)
    + f"""SELECT t.c AS y_true, p.c AS y_pred, count(s.y_true) AS n FROM {CLASSES.replace('cls', 't')} CROSS JOIN {CLASSES.replace('cls', 'p')}
  LEFT JOIN scored s ON s.y_true = t.c AND s.y_pred = p.c GROUP BY 1, 2"""
)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return mt.confusion(derive_scored(spark, d))


@query(
    with_ctes(FLOWS, SCORED, class_ctes())
    + "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class"
)
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.class_metrics(derive_scored(spark, d)), ["precision", "recall", "f1"])


@query(
    with_ctes(FLOWS, SCORED, class_ctes(keys="session_id"), f"s AS ({summary_select('session_id')})")
    + f"SELECT session_id, samples, {SUMMARY_SQL}, evaluation_status FROM s"
)
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.summary_metrics(derive_scored(spark, d), ["session_id"]), SUMMARY)


@query(with_ctes(FLOWS, SCORED, f"a AS ({attack_sql(keys='session_id')})") + f"SELECT session_id, tp, tn, fp, fn, {RATIO_SQL} FROM a")
def attack_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.attack_metrics(derive_scored(spark, d), ["session_id"]), RATIOS)


RANKED = """_s AS (SELECT 'BENIGN' AS class, p_benign AS score, y_true FROM scored UNION ALL SELECT 'DDoS', p_ddos, y_true FROM scored
  UNION ALL SELECT 'DoS', p_dos, y_true FROM scored UNION ALL SELECT 'PortScan', p_portscan, y_true FROM scored),
_g AS (SELECT class, score, count(*) FILTER (WHERE y_true = class) AS pos, count(*) FILTER (WHERE y_true <> class) AS neg FROM _s GROUP BY 1, 2),
_r AS (SELECT *, sum(pos) OVER c AS pa, sum(neg) OVER c AS na, sum(neg) OVER u - neg AS nb, sum(pos) OVER w AS p, sum(neg) OVER w AS n FROM _g
  WINDOW w AS (PARTITION BY class), c AS (PARTITION BY class ORDER BY score DESC), u AS (PARTITION BY class ORDER BY score)),
ranking AS (SELECT class, sum(CAST(pos AS DOUBLE) * (nb + neg / 2)) / max(CAST(p AS DOUBLE) * n) AS roc_auc, sum(CAST(pos AS DOUBLE) / p * pa / (pa + na)) AS average_precision
  FROM _r WHERE p > 0 AND n > 0 GROUP BY 1)"""


@query(
    with_ctes(FLOWS, SCORED, RANKED)
    + "SELECT class, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM ranking"
)
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.ranking_metrics(derive_scored(spark, d)), ["roc_auc", "average_precision"])


@query(
    with_ctes(FLOWS, SCORED, RANKED)
    + "SELECT round(avg(roc_auc), 6) AS multiclass_roc_auc, round(avg(average_precision), 6) AS multiclass_pr_auc FROM ranking HAVING count(*) = 4"
)
def macro_ranking(spark: SparkSession, d: str) -> DataFrame:
    out = mt.macro_ranking_metrics(mt.ranking_metrics(derive_scored(spark, d)))
    return rounded(out, ["multiclass_roc_auc", "multiclass_pr_auc"])


CLIPPED = """_q AS (SELECT *, greatest(p_benign, 1E-12) AS a, greatest(p_ddos, 1E-12) AS b, greatest(p_dos, 1E-12) AS c, greatest(p_portscan, 1E-12) AS e FROM scored),
clipped AS (SELECT y_true, y_pred, y_true = y_pred AS ok, a / (a + b + c + e) AS a, b / (a + b + c + e) AS b, c / (a + b + c + e) AS c, e / (a + b + c + e) AS e,
  greatest(a, b, c, e) / (a + b + c + e) AS conf FROM _q)"""
BIN = "CASE WHEN conf >= 0.9E0 THEN 9 WHEN conf >= 0.8E0 THEN 8 WHEN conf >= 0.7000000000000001E0 THEN 7 WHEN conf >= 0.6000000000000001E0 THEN 6 WHEN conf >= 0.5E0 THEN 5 WHEN conf >= 0.4E0 THEN 4 WHEN conf >= 0.30000000000000004E0 THEN 3 WHEN conf >= 0.2E0 THEN 2 WHEN conf >= 0.1E0 THEN 1 ELSE 0 END"
BINS = f"bins AS (SELECT {BIN} AS bin, count(*) AS n, avg(conf) AS mc, avg(CAST(ok AS INT)) AS acc FROM clipped GROUP BY 1)"
QUALITY = ["average_confidence", "confidence_correct", "confidence_incorrect", "multiclass_log_loss", "multiclass_brier_score", "expected_calibration_error"]


@query(
    with_ctes(FLOWS, SCORED, CLIPPED, BINS)
    + """SELECT round(avg(conf), 6) AS average_confidence, round(avg(conf) FILTER (WHERE ok), 6) AS confidence_correct, round(avg(conf) FILTER (WHERE NOT ok), 6) AS confidence_incorrect,
  round(avg(-ln(CASE y_true WHEN 'BENIGN' THEN a WHEN 'DDoS' THEN b WHEN 'DoS' THEN c ELSE e END)), 6) AS multiclass_log_loss,
  round(avg((a - CAST(y_true = 'BENIGN' AS INT)) ** 2 + (b - CAST(y_true = 'DDoS' AS INT)) ** 2 + (c - CAST(y_true = 'DoS' AS INT)) ** 2 + (e - CAST(y_true = 'PortScan' AS INT)) ** 2), 6) AS multiclass_brier_score,
  round((SELECT sum(n * abs(mc - acc)) / sum(n) FROM bins), 6) AS expected_calibration_error FROM clipped"""
)
def probability_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.probability_quality(derive_scored(spark, d)), QUALITY)


@query(
    with_ctes(FLOWS, SCORED, CLIPPED, BINS)
    + """SELECT CAST(i AS INT) AS bin, round(i / 10, 1) AS lower, round((i + 1) / 10, 1) AS upper, coalesce(n, 0) AS n, round(mc, 6) AS mean_confidence, round(acc, 6) AS observed_accuracy
  FROM range(10) r(i) LEFT JOIN bins ON bin = i"""
)
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(mt.calibration(derive_scored(spark, d)), ["mean_confidence", "observed_accuracy"])
    return rounded(out, ["lower", "upper"], 1)


CURRENT = "cur AS (SELECT *, lag(y_true) OVER (PARTITION BY session_id ORDER BY flow_seq) AS current_state FROM scored)"


def _with_current(scored: DataFrame) -> DataFrame:
    """Truth of the preceding scored flow."""
    from netstate.scale import with_previous

    return with_previous(scored, ["session_id"], "flow_seq", ["y_true"], "prev_").withColumnRenamed("prev_y_true", "current_state")


@query(
    with_ctes(FLOWS, SCORED, CURRENT)
    + """SELECT current_state, y_true AS actual_state, count(*) AS n, count(*) FILTER (WHERE y_pred = y_true) AS correct, round(avg(CAST(y_pred = y_true AS INT)), 6) AS accuracy,
  round(avg(CASE y_true WHEN 'BENIGN' THEN p_benign WHEN 'DDoS' THEN p_ddos WHEN 'DoS' THEN p_dos ELSE p_portscan END), 6) AS mean_true_probability, count(*) < 30 AS low_support
  FROM cur WHERE current_state IS NOT NULL GROUP BY 1, 2"""
)
def transition_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = mt.transition_metrics(_with_current(derive_scored(spark, d)))
    return rounded(out, ["accuracy", "mean_true_probability"])


_ROWS = "ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING"
SAMPLES = f"""_o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY flow_seq) AS rn FROM scored),
samples AS (SELECT session_id, flow_seq, list(y_true) OVER h AS hist, list(y_true) OVER f AS y, list(p_benign) OVER f AS a, list(p_ddos) OVER f AS b, list(p_dos) OVER f AS c, list(p_portscan) OVER f AS e
  FROM _o WINDOW h AS (PARTITION BY session_id ORDER BY flow_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f AS (PARTITION BY session_id ORDER BY flow_seq {_ROWS})
  QUALIFY len(hist) = 5 AND len(y) = 6),
hp AS (SELECT session_id, flow_seq, CAST(i AS INT) AS horizon, y[i] AS y_true, a[i] AS p_benign, b[i] AS p_ddos, c[i] AS p_dos, e[i] AS p_portscan, CASE greatest(a[i], b[i], c[i], e[i]) WHEN a[i] THEN 'BENIGN' WHEN b[i] THEN 'DDoS' WHEN c[i] THEN 'DoS' ELSE 'PortScan' END AS y_pred
  FROM samples, range(1, 7) r(i))"""


def horizon_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of five past truths, six future truths and six future probability vectors per session."""
    from netstate.scale import with_halo, with_position

    scored = with_position(derive_scored(spark, d), ["session_id"], "flow_seq", position="rn")
    chunked = with_halo(scored, "rn", 4, 6, bits=12)
    frame = Window.partitionBy("session_id", "_chunk").orderBy("rn")
    past, ahead = frame.rowsBetween(-4, 0), frame.rowsBetween(1, 6)
    vector = F.array(*[F.col(p) for p in mt.PROBABILITIES])
    out = chunked.select(
        "session_id", "flow_seq", "_owned", F.collect_list("y_true").over(past).alias("history"),
        F.collect_list("y_true").over(ahead).alias("y"), F.collect_list(vector).over(ahead).alias("p"),
    )
    return out.where(F.col("_owned") & (F.size("history") == 5) & (F.size("y") == 6)).drop("_owned")


HORIZON = class_ctes("hp", "horizon") + f", hs AS ({summary_select('horizon')}), ha AS ({attack_sql('hp', 'horizon')})"


@query(
    with_ctes(FLOWS, SCORED, SAMPLES, HORIZON)
    + f"SELECT horizon, samples, {SUMMARY_SQL}, evaluation_status, round(ha.f1, 6) AS attack_f1 FROM hs JOIN ha USING (horizon)"
)
def horizon_metrics(spark: SparkSession, d: str) -> DataFrame:
    predictions = stage(hz.explode_horizons(horizon_samples(spark, d)))
    return rounded(hz.horizon_metrics(predictions), [*SUMMARY, "attack_f1"])


@query(
    with_ctes(FLOWS, SCORED, SAMPLES, HORIZON)
    + """SELECT horizon, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(ha.f1, 6) AS attack_f1, round(accuracy - first(accuracy) OVER (ORDER BY horizon), 6) AS accuracy_delta_from_h1,
  round(macro_f1 - first(macro_f1) OVER (ORDER BY horizon), 6) AS macro_f1_delta_from_h1 FROM hs JOIN ha USING (horizon)"""
)
def horizon_degradation(spark: SparkSession, d: str) -> DataFrame:
    predictions = stage(hz.explode_horizons(horizon_samples(spark, d)))
    out = hz.degradation(hz.horizon_metrics(predictions))
    return rounded(out, ["accuracy", "macro_f1", "attack_f1", "accuracy_delta_from_h1", "macro_f1_delta_from_h1"])


SWEEP = """sweep AS (SELECT CAST(t AS DOUBLE) AS threshold, coalesce(2.0E0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS attack_f1, coalesce(fp / nullif(fp + tn, 0), 0) AS false_positive_rate FROM (
  SELECT t, count(*) FILTER (WHERE y_true <> 'BENIGN' AND w) AS tp, count(*) FILTER (WHERE y_true = 'BENIGN' AND NOT w) AS tn, count(*) FILTER (WHERE y_true = 'BENIGN' AND w) AS fp,
    count(*) FILTER (WHERE y_true <> 'BENIGN' AND NOT w) AS fn FROM (SELECT y_true, t, 1.0E0 - p_benign >= t AS w FROM hp, (VALUES (0.5E0), (0.6E0), (0.7E0), (0.8E0), (0.9E0)) v(t)) GROUP BY t))"""


@query(
    with_ctes(FLOWS, SCORED, SAMPLES, SWEEP)
    + "SELECT threshold, round(attack_f1, 6) AS attack_f1, round(false_positive_rate, 6) AS false_positive_rate FROM sweep"
)
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    out = hz.threshold_sweep(hz.explode_horizons(horizon_samples(spark, d)))
    return rounded(out, ["attack_f1", "false_positive_rate"])


@query(
    with_ctes(FLOWS, SCORED, SAMPLES, SWEEP)
    + "SELECT arg_min(threshold, (-attack_f1, threshold)) AS selected_threshold FROM sweep WHERE false_positive_rate <= 0.5E0"
)
def selected_threshold(spark: SparkSession, d: str) -> DataFrame:
    return hz.select_threshold(hz.threshold_sweep(hz.explode_horizons(horizon_samples(spark, d))), max_fpr=0.5)


@query(
    with_ctes(FLOWS, SCORED, SAMPLES,
        """o AS (SELECT session_id, flow_seq, min(horizon) FILTER (WHERE y_true <> 'BENIGN') AS act, min(horizon) FILTER (WHERE 1.0E0 - p_benign >= 0.6E0) AS pred FROM hp GROUP BY 1, 2),
q AS (SELECT o.* FROM o JOIN samples USING (session_id, flow_seq) WHERE len(list_distinct(hist)) = 1 AND hist[1] = 'BENIGN')""")
    + """SELECT count(act) AS supported_onsets, count(act + pred) AS detected, count(*) FILTER (WHERE act IS NOT NULL AND pred IS NULL) AS misses, count(*) FILTER (WHERE act IS NULL AND pred IS NOT NULL) AS false_warnings,
  count(*) FILTER (WHERE pred < act) AS early_detections, count(*) FILTER (WHERE pred = act) AS on_time_detections, count(*) FILTER (WHERE pred > act) AS late_detections,
  round(avg(pred - act), 6) AS mean_horizon_error, round(avg(act - pred) FILTER (WHERE pred < act), 6) AS mean_lead_windows FROM q"""
)
def onset_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hz.onset_metrics(horizon_samples(spark, d), 0.6), ["mean_horizon_error", "mean_lead_windows"])


@query(
    with_ctes(FLOWS, SCORED, SAMPLES)
    + """SELECT session_id, flow_seq, CAST(coalesce(min(horizon) FILTER (WHERE 1.0E0 - p_benign >= 0.9E0), 0) AS INT) AS earliest_attack_horizon, round(max(1.0E0 - p_benign), 6) AS maximum_attack_probability FROM hp GROUP BY 1, 2"""
)
def earliest_warning(spark: SparkSession, d: str) -> DataFrame:
    predictions = hz.explode_horizons(horizon_samples(spark, d), ["session_id", "flow_seq"])
    out = hz.earliest_warning(predictions, 0.9, ["session_id", "flow_seq"])
    return rounded(out, ["maximum_attack_probability"]).select(
        "session_id", "flow_seq", F.coalesce("earliest_attack_horizon", F.lit(0)).cast("int").alias("earliest_attack_horizon"), "maximum_attack_probability"
    )


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return seq.multistep_sequences(window_states(derive_flows(spark, d), HOUR), features=["flow_count"])


@query(
    with_ctes(FLOWS, states(), MULTISTEP.format(source="states"))
    + """SELECT session_id, CAST(i AS INT) AS horizon, count(*) AS samples, round(avg(CAST(fl[i] = hl[5] AS INT)), 6) AS accuracy FROM multi, range(1, 7) r(i) GROUP BY 1, 2"""
)
def persistence_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hz.persistence_accuracy(_sequences(spark, d)), ["accuracy"])


_COUNT_CLASSES = ", ".join(f'count(*) FILTER (WHERE {{x}} = \'{c}\') AS "{c}"' for c in STATE_CLASSES)


@query(
    with_ctes(FLOWS, states(), MULTISTEP.format(source="states"))
    + f"SELECT session_id, CAST(i AS INT) AS horizon, {_COUNT_CLASSES.format(x='fl[i]')} FROM multi, range(1, 7) r(i) GROUP BY 1, 2"
)
def distribution_by_horizon(spark: SparkSession, d: str) -> DataFrame:
    return hz.distribution_by_horizon(_sequences(spark, d), ["session_id"])


@query(
    with_ctes(FLOWS, states(), NUMBERED, CHRONO)
    + f"SELECT session_id, split, {_COUNT_CLASSES.format(x='dominant_state')} FROM ch GROUP BY 1, 2"
)
def class_support_by_split(spark: SparkSession, d: str) -> DataFrame:
    parts = splits.chronological_split(stage(window_states(derive_flows(spark, d), HOUR)))
    return mt.class_distribution(parts, "dominant_state", ["session_id", "split"]).drop("low_support_classes")


@query(
    with_ctes(FLOWS, SCORED, """paired AS (SELECT 'model' AS model, y_true, y_pred FROM scored UNION ALL SELECT 'constant', y_true, 'BENIGN' FROM scored)""",
              class_ctes("paired", "model"), f"s AS ({summary_select('model')})")
    + """SELECT metric, round(max(value) FILTER (WHERE model = 'model'), 6) AS model, round(max(value) FILTER (WHERE model = 'constant'), 6) AS constant
  FROM (SELECT model, accuracy, balanced_accuracy, macro_f1, weighted_f1 FROM s) UNPIVOT (value FOR metric IN (accuracy, balanced_accuracy, macro_f1, weighted_f1)) GROUP BY 1"""
)
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    scored = derive_scored(spark, d).select("y_true", "y_pred")
    both = scored.withColumn("model", F.lit("model")).unionByName(
        scored.withColumn("y_pred", F.lit("BENIGN")).withColumn("model", F.lit("constant"))
    )
    names = ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1"]
    out = mt.compare_models(mt.summary_metrics(both, ["model"]), ["model", "constant"], names)
    return rounded(out, ["model", "constant"])


FOLDED = "folded AS (SELECT CAST(coalesce(fold, 0) AS INT) AS fold, y_true, y_pred FROM (SELECT flow_seq % 3 + 1 AS fold, y_true, y_pred FROM scored UNION ALL SELECT NULL, y_true, y_pred FROM scored))"


@query(
    with_ctes(FLOWS, SCORED, FOLDED, class_ctes("folded", "fold"), f"s AS ({summary_select('fold')})")
    + f"SELECT fold, samples, {SUMMARY_SQL}, evaluation_status FROM s"
)
def walk_forward_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics per fold and pooled over folds (fold 0)."""
    scored = derive_scored(spark, d).withColumn("fold", (F.col("flow_seq") % 3 + 1).cast("int"))
    pooled = scored.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit(0))))
    return rounded(mt.summary_metrics(pooled, ["fold"]), SUMMARY)


@query(
    with_ctes(FLOWS, SCORED)
    + """SELECT bool_and(isfinite(p_benign) AND isfinite(p_ddos) AND isfinite(p_dos) AND isfinite(p_portscan)) AS finite_probabilities,
  bool_and(abs(p_benign + p_ddos + p_dos + p_portscan - 1) <= 1E-5) AS probability_sums, count(DISTINCT y_pred) >= 2 AS prediction_diversity FROM scored"""
)
def probability_sanity(spark: SparkSession, d: str) -> DataFrame:
    return probability_checks(derive_scored(spark, d), mt.PROBABILITIES)


@query(
    with_ctes(FLOWS, SCORED, "paired AS (SELECT 'model' AS model, y_true, y_pred FROM scored UNION ALL SELECT 'constant', y_true, 'BENIGN' FROM scored)",
              class_ctes("paired", "model"), f"s AS ({summary_select('model')})", f"a AS ({attack_sql('paired', 'model')})")
    + """SELECT 'macro_f1_improves' AS gate, (SELECT macro_f1 FROM s WHERE model = 'model') > (SELECT macro_f1 FROM s WHERE model = 'constant') AS passed
  UNION ALL SELECT 'ddos_support', (SELECT support FROM per_class WHERE model = 'model' AND class = 'DDoS') > 0
  UNION ALL SELECT 'ddos_recall_improves', (SELECT recall FROM per_class WHERE model = 'model' AND class = 'DDoS') > (SELECT recall FROM per_class WHERE model = 'constant' AND class = 'DDoS')
  UNION ALL SELECT 'benign_fpr_within_one_point', (SELECT false_positive_rate FROM a WHERE model = 'model') <= (SELECT false_positive_rate FROM a WHERE model = 'constant') + 0.01E0"""
)
def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    scored = derive_scored(spark, d).select("y_true", "y_pred")
    both = scored.withColumn("model", F.lit("model")).unionByName(
        scored.withColumn("y_pred", F.lit("BENIGN")).withColumn("model", F.lit("constant"))
    )
    by = ["model"]
    return gates(mt.summary_metrics(both, by), mt.class_metrics(both, by), mt.attack_metrics(both, by), "model", "constant")


def ranked_sql(source: str, key: str) -> str:
    """Ranking metrics per class and key."""
    parts = " UNION ALL ".join(
        f"SELECT {key}, '{c}' AS class, {p} AS score, y_true FROM {source}" for c, p in zip(STATE_CLASSES, mt.PROBABILITIES)
    )
    return f"""_s AS ({parts}),
_g AS (SELECT {key}, class, score, count(*) FILTER (WHERE y_true = class) AS pos, count(*) FILTER (WHERE y_true <> class) AS neg FROM _s GROUP BY 1, 2, 3),
_r AS (SELECT *, sum(pos) OVER c AS pa, sum(neg) OVER c AS na, sum(neg) OVER u - neg AS nb, sum(pos) OVER w AS p, sum(neg) OVER w AS n FROM _g
  WINDOW w AS (PARTITION BY {key}, class), c AS (PARTITION BY {key}, class ORDER BY score DESC), u AS (PARTITION BY {key}, class ORDER BY score)),
ranking AS (SELECT {key}, class, round(sum(CAST(pos AS DOUBLE) * (nb + neg / 2)) / max(CAST(p AS DOUBLE) * n), 6) AS roc_auc, round(sum(CAST(pos AS DOUBLE) / p * pa / (pa + na)), 6) AS average_precision
  FROM _r WHERE p > 0 AND n > 0 GROUP BY 1, 2)"""


def quality_sql(source: str, key: str) -> str:
    """Confidence, log loss, Brier score, calibration error and bins per key."""
    return f"""_q AS (SELECT *, greatest(p_benign, 1E-12) AS a, greatest(p_ddos, 1E-12) AS b, greatest(p_dos, 1E-12) AS c, greatest(p_portscan, 1E-12) AS e FROM {source}),
clipped AS (SELECT {key}, y_true, y_true = y_pred AS ok, a / (a + b + c + e) AS a, b / (a + b + c + e) AS b, c / (a + b + c + e) AS c, e / (a + b + c + e) AS e, greatest(a, b, c, e) / (a + b + c + e) AS conf FROM _q),
bins AS (SELECT {key}, {BIN} AS bin, count(*) AS n, avg(conf) AS mc, avg(CAST(ok AS INT)) AS acc FROM clipped GROUP BY 1, 2),
gaps AS (SELECT {key}, round(sum(n * abs(mc - acc)) / sum(n), 6) AS expected_calibration_error FROM bins GROUP BY 1),
quality AS (SELECT {key}, round(avg(conf), 6) AS average_confidence, round(avg(conf) FILTER (WHERE ok), 6) AS confidence_correct, round(avg(conf) FILTER (WHERE NOT ok), 6) AS confidence_incorrect,
  round(avg(-ln(CASE y_true WHEN 'BENIGN' THEN a WHEN 'DDoS' THEN b WHEN 'DoS' THEN c ELSE e END)), 6) AS multiclass_log_loss,
  round(avg((a - CAST(y_true = 'BENIGN' AS INT)) ** 2 + (b - CAST(y_true = 'DDoS' AS INT)) ** 2 + (c - CAST(y_true = 'DoS' AS INT)) ** 2 + (e - CAST(y_true = 'PortScan' AS INT)) ** 2), 6) AS multiclass_brier_score FROM clipped GROUP BY 1)"""


def _horizons(spark: SparkSession, d: str) -> DataFrame:
    return stage(hz.explode_horizons(horizon_samples(spark, d)))


@query(with_ctes(FLOWS, SCORED, SAMPLES, ranked_sql("hp", "horizon")) + "SELECT * FROM ranking")
def horizon_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.ranking_metrics(_horizons(spark, d), ["horizon"]), ["roc_auc", "average_precision"])


@query(with_ctes(FLOWS, SCORED, SAMPLES, quality_sql("hp", "horizon")) + "SELECT * FROM quality JOIN gaps USING (horizon)")
def horizon_probability_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.probability_quality(_horizons(spark, d), ["horizon"]), QUALITY)


@query(
    with_ctes(FLOWS, SCORED, SAMPLES, quality_sql("hp", "horizon"))
    + """SELECT h.horizon, CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(mc, 6) AS mean_confidence, round(acc, 6) AS observed_accuracy
  FROM (SELECT DISTINCT horizon FROM hp) h CROSS JOIN range(10) r(i) LEFT JOIN bins ON bin = i AND bins.horizon = h.horizon"""
)
def horizon_calibration(spark: SparkSession, d: str) -> DataFrame:
    out = mt.calibration(_horizons(spark, d), ["horizon"]).drop("lower", "upper")
    return rounded(out, ["mean_confidence", "observed_accuracy"])


_FOLD_EDGES = [f"{edge!r}E0" for edge in splits.fold_edges()]
ROLLED = f"""_n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY flow_seq) AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM scored),
rolled AS (SELECT * FROM (SELECT *, least(greatest(te + 6, CAST(floor(n * hi) AS BIGINT)), n) AS ve FROM (
    SELECT *, greatest(6, CAST(floor(n * lo) AS BIGINT)) AS te FROM _n,
      (VALUES (1, {_FOLD_EDGES[0]}, {_FOLD_EDGES[1]}), (2, {_FOLD_EDGES[1]}, {_FOLD_EDGES[2]}), (3, {_FOLD_EDGES[2]}, {_FOLD_EDGES[3]})) f(fold, lo, hi) WHERE n >= 24))
  WHERE ve - te - 5 > 5 AND pos > te + 5 AND pos <= ve)"""


def _rolled(spark: SparkSession, d: str) -> DataFrame:
    """Scored flows in the validation part of each expanding fold of their session."""
    ordered = derive_scored(spark, d).withColumnRenamed("flow_seq", "window_id")
    return stage(splits.rolling_folds(ordered, bits=20).where("role = 'validation'"))


@query(
    with_ctes(FLOWS, SCORED, ROLLED, class_ctes("rolled", "fold"), f"s AS ({summary_select('fold')})", f"a AS ({attack_sql('rolled', 'fold')})")
    + f"SELECT fold, samples, {SUMMARY_SQL}, evaluation_status, round(a.f1, 6) AS attack_f1 FROM s JOIN a USING (fold)"
)
def rolling_fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _rolled(spark, d)
    attack = mt.attack_metrics(rows, ["fold"]).select("fold", F.col("f1").alias("attack_f1"))
    return rounded(mt.summary_metrics(rows, ["fold"]).join(attack, "fold"), [*SUMMARY, "attack_f1"])


@query(with_ctes(FLOWS, SCORED, ROLLED, ranked_sql("rolled", "fold")) + "SELECT * FROM ranking")
def rolling_fold_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.ranking_metrics(_rolled(spark, d), ["fold"]), ["roc_auc", "average_precision"])


@query(with_ctes(FLOWS, SCORED, ROLLED, quality_sql("rolled", "fold")) + "SELECT * FROM quality JOIN gaps USING (fold)")
def rolling_fold_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.probability_quality(_rolled(spark, d), ["fold"]), QUALITY)


@query(
    with_ctes(FLOWS, SCORED, ROLLED, "m AS (SELECT * FROM rolled WHERE fold = 3)", "paired AS (SELECT 'model' AS model, y_true, y_pred FROM m UNION ALL SELECT 'constant', y_true, 'BENIGN' FROM m)",
              class_ctes("paired", "model"), f"s AS ({summary_select('model')})", f"a AS ({attack_sql('paired', 'model')})",
              "hp AS (SELECT y_true, p_benign FROM m)", SWEEP,
              """g AS (SELECT 'macro_f1_improves' AS gate, (SELECT macro_f1 FROM s WHERE model = 'model') > (SELECT macro_f1 FROM s WHERE model = 'constant') AS passed
  UNION ALL SELECT 'ddos_support', (SELECT support FROM per_class WHERE model = 'model' AND class = 'DDoS') > 0
  UNION ALL SELECT 'ddos_recall_improves', (SELECT recall FROM per_class WHERE model = 'model' AND class = 'DDoS') > (SELECT recall FROM per_class WHERE model = 'constant' AND class = 'DDoS')
  UNION ALL SELECT 'benign_fpr_within_one_point', (SELECT false_positive_rate FROM a WHERE model = 'model') <= (SELECT false_positive_rate FROM a WHERE model = 'constant') + 0.01E0
  UNION ALL SELECT 'ddos_training_support', (SELECT count(*) FROM rolled WHERE fold < 3 AND y_true = 'DDoS') > 0
  UNION ALL SELECT 'warning_threshold_selected', (SELECT count(*) FROM sweep WHERE false_positive_rate <= 0.05E0) > 0)""")
    + "SELECT gate, coalesce(passed, FALSE) AS passed FROM g UNION ALL SELECT 'active', bool_and(coalesce(passed, FALSE)) FROM g"
)
def activation_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates of the last fold against a constant forecast, with training support and a chosen warning threshold."""
    rows = _rolled(spark, d)
    last = rows.where("fold = 3").select("y_true", "y_pred", *mt.PROBABILITIES)
    both = last.select("y_true", "y_pred", F.lit("model").alias("model")).unionByName(
        last.select("y_true", F.lit("BENIGN").alias("y_pred"), F.lit("constant").alias("model"))
    )
    by = ["model"]
    promoted = gates(mt.summary_metrics(both, by), mt.class_metrics(both, by), mt.attack_metrics(both, by), "model", "constant")
    return activation(promoted, rows.where("fold < 3"), hz.select_threshold(hz.threshold_sweep(last)))


@query(
    with_ctes(FLOWS, states(), MULTISTEP.format(source="states"))
    + """SELECT session_id, CAST(i AS INT) AS horizon, count(*) AS samples, round(avg(CAST(fl[i] = hl[5] AS INT)), 6) AS accuracy, CAST(substr(session_id, 2) AS INT) - 1 AS session_rank,
  CASE WHEN session_id = 's1' THEN 'N/A' ELSE 'SCORED_THEN_ADVANCED' END AS status FROM multi, range(1, 7) r(i) GROUP BY 1, 2"""
)
def session_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Persistence per session and horizon; the first session has nothing before it."""
    sequences = stage(_sequences(spark, d))
    ranks = sequences.select("session_id").distinct().withColumn("session_rank", F.substring("session_id", 2, 2).cast("int") - 1)
    return rounded(rolling_session_diagnostics(sequences, ranks), ["accuracy"])


@query(with_ctes(FLOWS) + "SELECT session_id, flow_seq, sum(tot_fwd_pkts) OVER (PARTITION BY session_id ORDER BY flow_seq) AS packets_so_far FROM flows")
def running_packets(spark: SparkSession, d: str) -> DataFrame:
    """Forward packets of a session up to each flow."""
    flows = derive_flows(spark, d).select("session_id", "flow_seq", "tot_fwd_pkts")
    return with_running_total(flows, ["session_id"], "flow_seq", "tot_fwd_pkts", "packets_so_far", bits=10).drop("tot_fwd_pkts")


@query()
def chosen_weighting(spark: SparkSession, d: str) -> DataFrame:
    """Whether class weights help the forecaster over the rolling folds of hourly windows."""
    chosen = select_weighting(stage(window_states(derive_flows(spark, d), HOUR)))
    return spark.createDataFrame([(chosen,)], "selected_training string")
