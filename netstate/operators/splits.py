"""Chronological splits, folds, capped samples and train-only scaling.

All cuts use row numbers from per-bucket counts, never a whole session in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.constants import (
    EMBARGO_WINDOWS, HOLDOUT_RATIO, HORIZONS, ROLLING_FOLDS, SEQUENCE_LENGTH, STATE_FEATURES, TRAIN_RATIO,
    VALIDATION_RATIO,
)
from netstate.functions.values import literal_map
from netstate.scale import ROW_BITS, WINDOW_BITS, with_position

SESSION = ("session_id",)


def _numbered(states: DataFrame, keys: Sequence[str], bits: int, order: str = "window_id") -> DataFrame:
    return with_position(states, keys, order, bits, "_position", "_total")


def chronological_split(
    states: DataFrame, keys: Sequence[str] = SESSION, train: float = TRAIN_RATIO,
    validation: float = VALIDATION_RATIO, bits: int = WINDOW_BITS,
) -> DataFrame:
    """Add `split`: the first windows train, the next validate, the rest test. Halves round to even."""
    n_train = F.bround(F.col("_total") * F.lit(train))
    n_validation = F.bround(F.col("_total") * F.lit(validation))
    split = (
        F.when(F.col("_position") <= n_train, F.lit("train"))
        .when(F.col("_position") <= n_train + n_validation, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return _numbered(states, keys, bits).withColumn("split", split).drop("_position", "_total")


def split_bounds(split_states: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """First and last window of every split."""
    return split_states.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min("window_id").alias("first_window"),
        F.max("window_id").alias("last_window"),
    )


def holdout_split(
    states: DataFrame, length: int = SEQUENCE_LENGTH, holdout: float = HOLDOUT_RATIO, keys: Sequence[str] = SESSION,
    bits: int = WINDOW_BITS,
) -> DataFrame:
    """Add `split` train/holdout; `length` windows after the cut are dropped."""
    cut = F.least(
        F.greatest(F.lit(length + 1), F.floor(F.col("_total") * F.lit(1.0 - holdout))), F.col("_total")
    )
    split = F.when(F.col("_position") <= cut, F.lit("train")).when(F.col("_position") > cut + length, F.lit("holdout"))
    numbered = _numbered(states, keys, bits).withColumn("split", split)
    return numbered.where(F.col("split").isNotNull()).drop("_position", "_total")


def development_split(
    states: DataFrame, length: int = SEQUENCE_LENGTH, keys: Sequence[str] = SESSION, bits: int = WINDOW_BITS
) -> DataFrame:
    """Cut development windows 90/10 into train and validation without a purge."""
    cut = F.greatest(F.lit(length + 1), F.floor(F.col("_total") * F.lit(0.90)))
    split = F.when(F.col("_position") <= cut, F.lit("train")).otherwise(F.lit("validation"))
    return _numbered(states, keys, bits).withColumn("split", split).drop("_position", "_total")


def final_split(states: DataFrame, length: int = SEQUENCE_LENGTH, keys: Sequence[str] = SESSION) -> DataFrame:
    """Train, validation and purged test windows of the final fit."""
    halves = holdout_split(states, length, keys=keys)
    development = development_split(halves.where(F.col("split") == "train").drop("split"), length, keys)
    test = halves.where(F.col("split") == "holdout").withColumn("split", F.lit("test"))
    return development.unionByName(test)


def fold_edges(folds: int = ROLLING_FOLDS) -> list[float]:
    return [float(edge) for edge in np.linspace(0.40, 1.0, folds + 1)]


def rolling_folds(
    states: DataFrame, folds: int = ROLLING_FOLDS, length: int = SEQUENCE_LENGTH, keys: Sequence[str] = SESSION,
    bits: int = WINDOW_BITS,
) -> DataFrame:
    """Expanding-window folds: one row per (window, fold, role), with `length` windows purged before validation.

    Sessions shorter than (length + 1) * (folds + 1) windows and validation parts of at most `length` windows give none.
    """
    edges = fold_edges(folds)
    total, position = F.col("_total"), F.col("_position")
    choices = []
    for fold in range(folds):
        train_end = F.greatest(F.lit(length + 1), F.floor(total * F.lit(edges[fold])))
        end = F.least(F.greatest(train_end + length + 1, F.floor(total * F.lit(edges[fold + 1]))), total)
        role = F.when(position <= train_end, F.lit("train")).when(
            (position > train_end + length) & (position <= end), F.lit("validation")
        )
        usable = (end - train_end - length) > length
        choices.append(
            F.when(usable & role.isNotNull(), F.struct(F.lit(fold + 1).alias("fold"), role.alias("role")))
        )
    numbered = _numbered(states, keys, bits).where(total >= (length + 1) * (folds + 1))
    exploded = numbered.withColumn("_choice", F.explode(F.array_compact(F.array(*choices))))
    return exploded.select("*", "_choice.fold", "_choice.role").drop("_choice", "_position", "_total")


def session_bucket(session: Column, buckets: Mapping[str, str], default: str = "train") -> Column:
    """Split of a session by its name without a `.csv` suffix; unknown sessions go to `default`."""
    plain = {name.removesuffix(".csv"): bucket for name, bucket in buckets.items()}
    return F.coalesce(
        F.try_element_at(literal_map(plain), F.regexp_replace(session, r"\.csv$", "")), F.lit(default)
    )


def embargo_split(
    states: DataFrame, buckets: Mapping[str, str], partitioned: str, embargo: int = EMBARGO_WINDOWS,
    session: str = "session_id", bits: int = WINDOW_BITS,
) -> DataFrame:
    """Whole sessions go to their bucket; session `partitioned` is cut 60/20/20 with an embargo after each cut."""
    position, total = F.col("_position"), F.col("_total")
    train_end = F.floor(total * F.lit(0.60))
    validation_end = F.floor(total * F.lit(0.80))
    inside = (
        F.when(position <= train_end, F.lit("train"))
        .when((position > train_end + embargo) & (position <= validation_end), F.lit("validation"))
        .when(position > validation_end + embargo, F.lit("test"))
    )
    split = F.when(F.col(session) == partitioned, inside).otherwise(session_bucket(F.col(session), buckets))
    numbered = _numbered(states, [session], bits).withColumn("split", split)
    return numbered.where(F.col("split").isNotNull()).drop("_position", "_total")


def require_partition_length(
    split_states: DataFrame, partitioned: str, length: int = SEQUENCE_LENGTH, horizons: int = HORIZONS,
    session: str = "session_id",
) -> None:
    """Raise when a part of the partitioned session cannot hold one multi-step sample."""
    counts = split_states.where(F.col(session) == partitioned).groupBy("split").count().collect()
    sizes = {row["split"]: row["count"] for row in counts}
    short = [s for s in ("train", "validation", "test") if sizes.get(s, 0) < length + horizons]
    if short:
        raise RuntimeError(f"Session {partitioned} is too short for partitions with embargo gaps: {short}")


def first_per_class(
    rows: DataFrame, limit: int, label: str, order: str, bits: int = ROW_BITS, sessions: Sequence[str] = ()
) -> DataFrame:
    """The first `limit` rows of each class in source order; a NULL label is a class.

    Rows of several sessions stand in the order of the columns `sessions` (such as session_rank) and then of `order`.
    """
    numbered = with_position(rows, [label], order, bits, "_position", lead=sessions)
    return numbered.where(F.col("_position") <= limit).drop("_position")


def split_within_class(
    rows: DataFrame, label: str, order: str, ratio: float = 0.8, bits: int = ROW_BITS, sessions: Sequence[str] = ()
) -> DataFrame:
    """Cut every class in source order: the first max(1, int(ratio * count)) rows train, the rest validate.

    `sessions` as in `first_per_class`.
    """
    numbered = with_position(rows, [label], order, bits, "_position", "_total", lead=sessions)
    cut = F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(ratio)))
    split = F.when(F.col("_position") <= cut, F.lit("train")).otherwise(F.lit("validation"))
    return numbered.withColumn("split", split).drop("_position", "_total")


@dataclass(frozen=True)
class MinMaxModel:
    """Column ranges seen at fit time. Values outside the range scale outside [0, 1]; a constant column maps to 0."""

    minimum: dict[str, float]
    maximum: dict[str, float]
    rows: int

    def scaled(self, name: str, value: Column | None = None) -> Column:
        low, high = self.minimum[name], self.maximum[name]
        factor = 1.0 / (high - low) if high > low else 1.0
        return ((F.col(name) if value is None else value) - F.lit(low)) * F.lit(factor)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.scaled(name) for name in self.minimum})

    def transform_vectors(self, vectors: Column, features: Sequence[str]) -> Column:
        """Scale an array of feature vectors."""
        low = F.array(*[F.lit(self.minimum[f]) for f in features])
        spans = [self.maximum[f] - self.minimum[f] for f in features]
        factor = F.array(*[F.lit(1.0 / span if span > 0 else 1.0) for span in spans])

        def one(vector: Column) -> Column:
            shifted = F.zip_with(vector, low, lambda value, base: value - base)
            return F.zip_with(shifted, factor, lambda value, scale: value * scale)

        return F.transform(vectors, one)

    def save(self, spark, path: str) -> None:
        rows = [(name, self.minimum[name], self.maximum[name], self.rows) for name in self.minimum]
        spark.createDataFrame(rows, "feature string, minimum double, maximum double, fitted_rows long").coalesce(
            1
        ).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark, path: str) -> MinMaxModel:
        rows = spark.read.json(path).collect()
        return cls(
            {r["feature"]: r["minimum"] for r in rows}, {r["feature"]: r["maximum"] for r in rows},
            rows[0]["fitted_rows"],
        )


def fit_min_max(train: DataFrame, features: Sequence[str] = STATE_FEATURES) -> MinMaxModel:
    """Ranges of the training rows: one aggregate pass, one row back."""
    row = train.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min(f).cast("double").alias(f"min_{i}") for i, f in enumerate(features)],
        *[F.max(f).cast("double").alias(f"max_{i}") for i, f in enumerate(features)],
    ).first()
    if not row["_rows"]:
        raise ValueError("A scaler needs at least one training row.")
    return MinMaxModel(
        {f: row[f"min_{i}"] for i, f in enumerate(features)}, {f: row[f"max_{i}"] for i, f in enumerate(features)},
        row["_rows"],
    )
