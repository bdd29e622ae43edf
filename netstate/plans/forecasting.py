"""Train and evaluate window forecasters from stored windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.constants import ROLLING_FOLDS, SEQUENCE_LENGTH, STATE_FEATURES
from netstate.operators import audits
from netstate.operators import modeling as ml
from netstate.operators import sequences as seq
from netstate.operators import splits
from netstate.operators.horizons import persistence_predictions
from netstate.operators.metrics import attack_metrics, class_metrics, summary_metrics
from netstate.scale import stage

SESSION = ("session_id",)


def walk_forward(
    states: DataFrame, features: Sequence[str] = STATE_FEATURES, folds: int = ROLLING_FOLDS,
    length: int = SEQUENCE_LENGTH, iterations: int = 100, capped: bool = False,
) -> DataFrame:
    """Predictions of every rolling fold: trained on earlier windows, evaluated on the purged block that follows."""
    parts = stage(splits.rolling_folds(states, folds, length))
    sequences = stage(seq.sequences_gap_aware(parts, length, within=["fold", "role"], features=features))
    out = None
    for fold in range(1, folds + 1):
        here = F.col("fold") == fold
        train, windows = sequences.where(here & (F.col("role") == "train")), parts.where(here & (F.col("role") == "train"))
        if train.isEmpty():
            continue
        model = ml.fit_next_window(train, windows, features, capped, iterations)
        scored = model.transform(sequences.where(here & (F.col("role") == "validation"))).select(
            "session_id", "fold", "target_window_id", F.element_at("input_labels", -1).alias("current_state"),
            F.col("y_dominant_state").alias("y_true"), "y_pred", *ml.PROBABILITIES,
        )
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("No session is long enough for a rolling fold.")
    return out


def select_weighting(states: DataFrame, features: Sequence[str] = STATE_FEATURES, iterations: int = 100) -> str:
    """Training variant with the best mean fold macro F1; ties, and windows without a rolling fold, prefer the unweighted one."""
    scores = {}
    if splits.rolling_folds(states, ROLLING_FOLDS, SEQUENCE_LENGTH).isEmpty():
        return "unweighted"
    for name, capped in (("unweighted", False), ("capped_class_weighted", True)):
        folds = summary_metrics(walk_forward(states, features, iterations=iterations, capped=capped), ["fold"])
        scores[name] = [row["macro_f1"] for row in folds.select("macro_f1").collect()]
    return ml.select_candidate(scores)


def evaluate_against_persistence(
    states: DataFrame, features: Sequence[str] = STATE_FEATURES, iterations: int = 100, capped: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions of the forecaster and of the persistence baseline, and the promotion gates."""
    parts = stage(splits.final_split(states))
    sequences = stage(seq.sequences_gap_aware(parts, within=["split"], features=features))
    train = F.col("split") == "train"
    model = ml.fit_next_window(sequences.where(train), parts.where(train), features, capped, iterations)
    test = sequences.where(F.col("split") == "test")
    columns = ["session_id", "target_window_id", "y_true", "y_pred", "model"]
    scored = model.transform(test).withColumn("y_true", F.col("y_dominant_state")).withColumn("model", F.lit("forecast"))
    baseline = test.select(
        "session_id", "target_window_id", F.col("y_dominant_state").alias("y_true"),
        F.element_at("input_labels", -1).alias("y_pred"), F.lit("persistence").alias("model"),
    )
    both = stage(scored.select(*columns).unionByName(baseline))
    by = ["model"]
    gates = audits.promotion_gates(
        summary_metrics(both, by), class_metrics(both, by), attack_metrics(both, by), "forecast", "persistence"
    )
    return both, gates


def rolling_session_diagnostics(sequences: DataFrame, ranks: DataFrame) -> DataFrame:
    """Persistence accuracy per session and horizon, with the number of sessions that came before."""
    rows = persistence_predictions(sequences, list(SESSION))
    scored = rows.groupBy(*SESSION, "horizon").agg(
        F.count(F.lit(1)).alias("samples"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy")
    )
    status = F.when(F.col("session_rank") == 0, F.lit("N/A")).otherwise(F.lit("SCORED_THEN_ADVANCED"))
    return scored.join(ranks, list(SESSION)).withColumn("status", status)
