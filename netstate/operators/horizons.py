"""Metrics of multi-step forecasts.

A horizon table has one row per sample with `y` (array of states), `p` (array of four-class probability arrays) and
`history` (array of states).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netstate.constants import MAX_WARNING_FPR, STATE_CLASSES, WARNING_THRESHOLDS
from netstate.operators.metrics import PROBABILITIES, attack_metrics, summary_metrics, with_prediction


def explode_horizons(samples: DataFrame, keep: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """One row per (sample, horizon) in the layout of a prediction table."""
    zipped = samples.select(*keep, F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))))
    rows = zipped.select(
        *keep,
        (F.col("pos") + 1).alias("horizon"),
        F.col("col.y").alias("y_true"),
        *[F.col("col.p")[i].alias(name) for i, name in enumerate(PROBABILITIES)],
    )
    return with_prediction(rows)


def horizon_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary and attack F1 per horizon."""
    keys = [*by, "horizon"]
    attack = attack_metrics(predictions, keys).select(*keys, F.col("f1").alias("attack_f1"))
    return summary_metrics(predictions, keys).join(attack, keys)


def degradation(per_horizon: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each horizon against the first one."""
    ordered = Window.partitionBy(*by).orderBy("horizon")
    return per_horizon.select(
        *by,
        "horizon",
        "accuracy",
        "macro_f1",
        "attack_f1",
        (F.col("accuracy") - F.first("accuracy").over(ordered)).alias("accuracy_delta_from_h1"),
        (F.col("macro_f1") - F.first("macro_f1").over(ordered)).alias("macro_f1_delta_from_h1"),
    )


def threshold_sweep(predictions: DataFrame, thresholds: Sequence[float] = WARNING_THRESHOLDS) -> DataFrame:
    """Attack F1 and false-positive rate of every warning threshold over all horizons; undefined ratios are 0.

    All thresholds are counted in one pass.
    """
    actual = F.col("y_true") != "BENIGN"
    warned = [1.0 - F.col(PROBABILITIES[0]) >= F.lit(t) for t in thresholds]
    cells = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count_if(actual & w).alias("tp"),
            F.count_if(~actual & ~w).alias("tn"),
            F.count_if(~actual & w).alias("fp"),
            F.count_if(actual & ~w).alias("fn"),
        )
        for t, w in zip(thresholds, warned)
    ]
    counts = predictions.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    f1 = F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    fpr = F.when(fp + tn > 0, fp / (fp + tn)).otherwise(F.lit(0.0))
    return counts.select("threshold", f1.alias("attack_f1"), fpr.alias("false_positive_rate"))


def select_threshold(sweep: DataFrame, max_fpr: float = MAX_WARNING_FPR) -> DataFrame:
    """The eligible threshold with the best F1, the lower one on ties; NULL when none is eligible."""
    eligible = F.when(
        F.col("false_positive_rate") <= max_fpr, F.struct(F.col("attack_f1"), (-F.col("threshold")).alias("t"))
    )
    return sweep.agg((-F.max(eligible)["t"]).alias("selected_threshold"))


def _first_hit(flags: Column) -> Column:
    position = F.array_position(flags, True)
    return F.when(position > 0, position)


def onset_metrics(samples: DataFrame, threshold: float, y: str = "y", p: str = "p", history: str = "history") -> DataFrame:
    """First actual against first warned attack horizon, for samples whose whole history is benign."""
    actual = _first_hit(F.transform(F.col(y), lambda s: s != "BENIGN"))
    warned = _first_hit(F.transform(F.col(p), lambda v: (F.lit(1.0) - v[0]) >= F.lit(threshold)))
    quiet = F.forall(F.col(history), lambda s: s == "BENIGN")
    rows = samples.where(quiet).select(actual.alias("actual"), warned.alias("warned"))
    onset, alarm = F.col("actual").isNotNull(), F.col("warned").isNotNull()
    error = F.when(onset & alarm, F.col("warned") - F.col("actual"))
    return rows.agg(
        F.count_if(onset).alias("supported_onsets"),
        F.count_if(onset & alarm).alias("detected"),
        F.count_if(onset & ~alarm).alias("misses"),
        F.count_if(~onset & alarm).alias("false_warnings"),
        F.count_if(error < 0).alias("early_detections"),
        F.count_if(error == 0).alias("on_time_detections"),
        F.count_if(error > 0).alias("late_detections"),
        F.avg(error).alias("mean_horizon_error"),
        F.avg(F.when(error < 0, -error)).alias("mean_lead_windows"),
    )


def persistence_predictions(sequences: DataFrame, keep: Sequence[str] = ("session_id",)) -> DataFrame:
    """Baseline that repeats the last history state over every horizon."""
    return sequences.select(
        *keep, F.element_at("input_labels", -1).alias("y_pred"), F.posexplode("y_dominant").alias("_pos", "y_true")
    ).select(*keep, (F.col("_pos") + 1).alias("horizon"), "y_true", "y_pred")


def persistence_accuracy(sequences: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Accuracy of the persistence baseline per session and horizon."""
    rows = persistence_predictions(sequences, keys)
    return rows.groupBy(*keys, "horizon").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
    )


def distribution_by_horizon(
    sequences: DataFrame, by: Sequence[str] = ("split",), label: str = "y_dominant",
    classes: Sequence[str] = STATE_CLASSES,
) -> DataFrame:
    """Target class counts per group and horizon."""
    rows = sequences.select(*by, F.posexplode(label).alias("_pos", "_label"))
    return rows.groupBy(*by, (F.col("_pos") + 1).alias("horizon")).agg(
        *[F.count_if(F.col("_label") == c).alias(c) for c in classes]
    )


def earliest_warning(predictions: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """First horizon whose attack probability reaches the threshold, and the largest attack probability."""
    attack = 1.0 - F.col(PROBABILITIES[0])
    return predictions.groupBy(*keys).agg(
        F.min(F.when(attack >= threshold, F.col("horizon"))).alias("earliest_attack_horizon"),
        F.max(attack).alias("maximum_attack_probability"),
    )
