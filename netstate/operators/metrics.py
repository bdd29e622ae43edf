"""Classification, ranking and calibration metrics over prediction tables.

A prediction table has `y_true`, `y_pred` and, for probability metrics, one column per class. `by` adds grouping
columns (fold, horizon, model). Counts are reduced first; ranking metrics work on one row per distinct score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netstate.constants import ATTACK_CLASSES, LOW_SUPPORT, STATE_CLASSES
from netstate.functions.values import argmax_label
from netstate.scale import stage

PROBABILITIES = ["p_benign", "p_ddos", "p_dos", "p_portscan"]
CLIP = 1e-12
SCORE_BUCKET_ROWS = 200_000


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def with_prediction(df: DataFrame, probabilities: Sequence[str] = PROBABILITIES, name: str = "y_pred") -> DataFrame:
    """Class of the largest probability; ties go to the earlier class."""
    return df.withColumn(name, argmax_label([F.col(p) for p in probabilities], STATE_CLASSES))


def _pairs(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All class pairs with their counts; pairs that never occur count 0."""
    cells = [
        F.struct(
            F.lit(t).alias("y_true"),
            F.lit(p).alias("y_pred"),
            F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p)).alias("n"),
        )
        for t in STATE_CLASSES
        for p in STATE_CLASSES
    ]
    return df.groupBy(*by).agg(F.array(*cells).alias("_cells")).select(*by, F.inline("_cells"))


def class_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of the four classes; undefined ratios are 0."""
    per_class = _pairs(df, by).withColumn("class", F.explode(F.array(*[F.lit(c) for c in STATE_CLASSES])))
    hit_true, hit_pred = F.col("y_true") == F.col("class"), F.col("y_pred") == F.col("class")
    counts = per_class.groupBy(*by, "class").agg(
        F.sum(F.when(hit_true & hit_pred, F.col("n")).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit_pred, F.col("n")).otherwise(0)).alias("_predicted"),
        F.sum(F.when(hit_true, F.col("n")).otherwise(0)).alias("support"),
    )
    precision = F.coalesce(_ratio(F.col("_tp"), F.col("_predicted")), F.lit(0.0))
    recall = F.coalesce(_ratio(F.col("_tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(_ratio(2.0 * F.col("_tp"), F.col("_predicted") + F.col("support")), F.lit(0.0))
    return counts.select(*by, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def summary_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy over present classes, macro means over all four, support-weighted F1, status."""
    per_class = class_metrics(df, by)
    present = F.col("support") > 0
    hits = F.col("recall") * F.col("support")
    attacks = F.count_if(present & F.col("class").isin(ATTACK_CLASSES))
    total = F.sum("support")
    return per_class.groupBy(*by).agg(
        total.alias("samples"),
        (F.sum(hits) / total).alias("accuracy"),
        F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
        F.when(attacks == len(ATTACK_CLASSES), F.lit("sufficient_attack_support"))
        .when(attacks > 0, F.lit("limited_attack_support"))
        .otherwise(F.lit("benign_only_holdout"))
        .alias("evaluation_status"),
    )


def attack_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attack-versus-benign ratios; NULL where a ratio has no denominator."""
    truth, guess = F.col("y_true") != "BENIGN", F.col("y_pred") != "BENIGN"
    counts = df.groupBy(*by).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
    )
    return counts.select(*by, "tp", "tn", "fp", "fn", *attack_ratios())


def attack_ratios() -> list[Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    defined = (tp + fp > 0) & (tp + fn > 0)
    f1 = F.when(defined, F.coalesce(_ratio(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)))
    return [
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        f1.alias("f1"),
        _ratio(fp, fp + tn).alias("false_positive_rate"),
        _ratio(fn, fn + tp).alias("false_negative_rate"),
    ]


def _scores(df: DataFrame, by: Sequence[str], probabilities: Sequence[str]) -> DataFrame:
    """Positives and negatives per (class, distinct score)."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("class"), F.col(p).alias("score"), (F.col("y_true") == c).alias("hit"))
            for c, p in zip(STATE_CLASSES, probabilities)
        ]
    )
    return (
        df.select(*by, F.inline(entries))
        .groupBy(*by, "class", "score")
        .agg(F.count_if(F.col("hit")).alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    )


def _ranked_scores(
    df: DataFrame, by: Sequence[str], probabilities: Sequence[str], bucket_rows: int = SCORE_BUCKET_ROWS
) -> DataFrame:
    """Distinct scores with the positives and negatives that score below them.

    The distinct scores of a class are cut at their quantiles into buckets of about `bucket_rows`, so the running sums of
    one class are spread over many tasks; one row per bucket carries the sums of lower buckets.
    """
    keys = [*by, "class"]
    scores = stage(_scores(df, by, probabilities))
    sizes = {r["class"]: r["count"] for r in scores.groupBy("class").count().collect()}  # four rows at most
    buckets = math.ceil(max(sizes.values(), default=0) / bucket_rows)
    bucket = F.lit(0)
    if buckets > 1:
        quantiles = F.percentile_approx("score", [i / buckets for i in range(1, buckets)], 10 * buckets)
        cuts = {r["class"]: r["cuts"] for r in scores.groupBy("class").agg(quantiles.alias("cuts")).collect()}
        places = [
            F.when(F.col("class") == c, F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e <= F.col("score"))))
            for c, edges in cuts.items()
        ]
        bucket = F.coalesce(*places, F.lit(0))
    bucketed = scores.withColumn("_bucket", bucket)
    sums = bucketed.groupBy(*keys, "_bucket").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_pos").over(earlier), F.lit(0)).alias("_pos_before"),
        F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).alias("_neg_before"),
        F.sum("_pos").over(whole).alias("positives"),
        F.sum("_neg").over(whole).alias("negatives"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.join(offsets, [*keys, "_bucket"])
        .withColumns(
            {
                "pos_below": F.coalesce(F.sum("pos").over(inside), F.lit(0)) + F.col("_pos_before"),
                "neg_below": F.coalesce(F.sum("neg").over(inside), F.lit(0)) + F.col("_neg_before"),
            }
        )
        .drop("_pos_before", "_neg_before", "_bucket")
    )


def ranking_metrics(
    df: DataFrame, by: Sequence[str] = (), probabilities: Sequence[str] = PROBABILITIES,
    bucket_rows: int = SCORE_BUCKET_ROWS,
) -> DataFrame:
    """One-vs-rest ROC AUC (ties count half) and average precision per class; NULL for one-sided classes."""
    ranked = _ranked_scores(df, by, probabilities, bucket_rows)
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.max(F.col("positives").cast("double") * F.col("negatives"))
    hits_above = F.col("positives") - F.col("pos_below")
    all_above = hits_above + F.col("negatives") - F.col("neg_below")
    step = F.col("pos") / F.col("positives") * hits_above / all_above
    return (
        ranked.where(both)
        .groupBy(*by, "class")
        .agg((won / pairs).alias("roc_auc"), F.sum(step).alias("average_precision"))
    )


def macro_ranking_metrics(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the four classes, NULL unless every class has both sides."""
    complete = F.count(F.lit(1)) == len(STATE_CLASSES)
    return per_class.groupBy(*by).agg(
        F.when(complete, F.avg("roc_auc")).alias("multiclass_roc_auc"),
        F.when(complete, F.avg("average_precision")).alias("multiclass_pr_auc"),
    )


def _clipped(df: DataFrame, probabilities: Sequence[str]) -> DataFrame:
    """Probabilities clipped away from 0 and renormalised, with confidence and correctness."""
    cut = [F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1.0)) for p in probabilities]
    total = reduce(lambda a, b: a + b, cut)
    names = [f"_q{i}" for i in range(len(cut))]
    out = df.withColumns({n: c / total for n, c in zip(names, cut)})
    truth = [F.when(F.col("y_true") == c, F.col(n)) for c, n in zip(STATE_CLASSES, names)]
    squares = [
        (F.col(n) - (F.col("y_true") == c).cast("double")) * (F.col(n) - (F.col("y_true") == c).cast("double"))
        for c, n in zip(STATE_CLASSES, names)
    ]
    return out.withColumns(
        {
            "_confidence": F.greatest(*[F.col(n) for n in names]),
            "_correct": F.col("y_true") == F.col("y_pred"),
            "_truth": F.coalesce(*truth),
            "_brier": reduce(lambda a, b: a + b, squares),
        }
    )


def probability_quality(
    df: DataFrame, by: Sequence[str] = (), probabilities: Sequence[str] = PROBABILITIES
) -> DataFrame:
    """Mean confidence (all, right, wrong), multiclass log loss and Brier score, expected calibration error."""
    scored = _clipped(df, probabilities)
    quality = scored.groupBy(*by).agg(
        F.avg("_confidence").alias("average_confidence"),
        F.avg(F.when(F.col("_correct"), F.col("_confidence"))).alias("confidence_correct"),
        F.avg(F.when(~F.col("_correct"), F.col("_confidence"))).alias("confidence_incorrect"),
        F.avg(-F.ln("_truth")).alias("multiclass_log_loss"),
        F.avg("_brier").alias("multiclass_brier_score"),
        *_bin_sums(),
    )
    gaps = [F.coalesce(F.abs(F.col(f"_conf_{i}") - F.col(f"_hits_{i}")), F.lit(0.0)) for i in range(10)]
    total = reduce(lambda a, b: a + b, [F.col(f"_n_{i}") for i in range(10)])
    error = reduce(lambda a, b: a + b, gaps) / total
    helpers = [f"_{kind}_{i}" for kind in ("n", "conf", "hits") for i in range(10)]
    return quality.withColumn("expected_calibration_error", error).drop(*helpers)


def calibration_edges() -> list[float]:
    """Ten equal bins; the inner edges carry the rounding of the evenly spaced grid, e.g. 0.30000000000000004."""
    return [float(e) for e in np.linspace(0.0, 1.0, 11)]


def _bin(confidence: Column) -> Column:
    edges = calibration_edges()
    return reduce(lambda a, b: a + b, [(confidence >= F.lit(e)).cast("int") for e in edges[1:10]])


def _bin_sums() -> list[Column]:
    columns = []
    for i in range(10):
        here = _bin(F.col("_confidence")) == i
        columns += [
            F.count_if(here).alias(f"_n_{i}"),
            F.sum(F.when(here, F.col("_confidence"))).alias(f"_conf_{i}"),
            F.sum(F.when(here, F.col("_correct").cast("double"))).alias(f"_hits_{i}"),
        ]
    return columns


def calibration(df: DataFrame, by: Sequence[str] = (), probabilities: Sequence[str] = PROBABILITIES) -> DataFrame:
    """Ten half-open confidence bins, the last one closed; empty bins have count 0 and NULL means."""
    sums = _clipped(df, probabilities).groupBy(*by).agg(*_bin_sums())
    edges = calibration_edges()
    rows = [
        F.struct(
            F.lit(i).alias("bin"),
            F.lit(edges[i]).alias("lower"),
            F.lit(edges[i + 1]).alias("upper"),
            F.col(f"_n_{i}").alias("n"),
            _ratio(F.col(f"_conf_{i}"), F.col(f"_n_{i}")).alias("mean_confidence"),
            _ratio(F.col(f"_hits_{i}"), F.col(f"_n_{i}")).alias("observed_accuracy"),
        )
        for i in range(10)
    ]
    return sums.select(*by, F.inline(F.array(*rows)))


def transition_metrics(
    df: DataFrame, current: str = "current_state", by: Sequence[str] = (), probabilities: Sequence[str] = PROBABILITIES
) -> DataFrame:
    """Accuracy and mean true-class probability per (current -> actual) state pair."""
    truth = F.coalesce(*[F.when(F.col("y_true") == c, F.col(p)) for c, p in zip(STATE_CLASSES, probabilities)])
    known = F.col(current).isin(STATE_CLASSES) & F.col("y_true").isin(STATE_CLASSES)
    grouped = df.where(known).groupBy(*by, F.col(current).alias("current_state"), F.col("y_true").alias("actual_state"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("y_pred") == F.col("y_true")).alias("correct"),
        F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("accuracy"),
        F.avg(truth).alias("mean_true_probability"),
        (F.count(F.lit(1)) < LOW_SUPPORT).alias("low_support"),
    )


def agreement(df: DataFrame, model: str, signature: str) -> DataFrame:
    """Agreement of two labelers over rows both of them labelled, with the signature layer as truth."""
    both = df.where(F.col(model).isin(STATE_CLASSES) & F.col(signature).isin(STATE_CLASSES))
    pairs = both.select(F.col(signature).alias("y_true"), F.col(model).alias("y_pred"))
    return summary_metrics(pairs).select(
        F.col("samples").alias("n"), F.col("accuracy").alias("agreement_rate"), "macro_f1", "weighted_f1"
    )


def compare_models(metrics: DataFrame, models: Sequence[str], names: Sequence[str], model: str = "model") -> DataFrame:
    """Metric rows of several models side by side: one row per metric, one column per model."""
    long = metrics.select(model, *names).unpivot([model], list(names), "metric", "value")
    return long.groupBy("metric").pivot(model, list(models)).agg(F.first("value"))


def class_distribution(df: DataFrame, label: str, by: Sequence[str], classes: Sequence[str] = STATE_CLASSES) -> DataFrame:
    """Rows per class as columns, absent classes 0."""
    return df.groupBy(*by).agg(
        *[F.count_if(F.col(label) == c).alias(c) for c in classes],
        F.array_compact(
            F.array(*[F.when(F.count_if(F.col(label) == c) < LOW_SUPPORT, F.lit(c)) for c in classes])
        ).alias("low_support_classes"),
    )


def time_histogram(
    df: DataFrame, time: str = "timestamp", state: str = "effective_state", confidence: str | None = None,
    bin_seconds: int = 60, max_bins: int = 120,
) -> DataFrame:
    """Benign and attack rows, and mean confidence, in at most `max_bins` equal time bins over the whole span."""
    millis = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1000)
    timed = df.where(F.col(time).isNotNull()).withColumn("_ms", millis)
    low, high = timed.agg(F.min("_ms"), F.max("_ms")).first()
    if low is None:
        low = high = 0
    span = max(1, high - low)
    bins = min(max_bins, max(1, math.ceil(span / (bin_seconds * 1000))))
    position = F.least(F.lit(bins - 1), F.floor((F.col("_ms") - F.lit(low)) / F.lit(span) * F.lit(bins)))
    attack = F.col(state) != "BENIGN"
    extra = [F.avg(confidence).alias("mean_confidence")] if confidence else []
    return timed.groupBy(position.cast("int").alias("bin")).agg(
        F.count_if(~attack).alias("benign"), F.count_if(attack).alias("attack"), *extra
    )
