"""Build, store and validate a temporal dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.constants import INVALID_STATE, SEQUENCE_LENGTH, STATE_CLASSES, STATE_FEATURES, WINDOW_SECONDS
from netstate.functions.columns import find_id_columns
from netstate.functions.timestamps import parse_timestamps
from netstate.operators import audits, splits
from netstate.operators import sequences as seq
from netstate.operators.states import assign_windows, window_states
from netstate.operators.transitions import transitions

SESSION = ("session_id",)


def validate_dataset(
    flows: DataFrame, states: DataFrame, changes: DataFrame, sequences: DataFrame, split_sequences: DataFrame,
    window_seconds: int = WINDOW_SECONDS, row_columns: Sequence[str] | None = None,
    length: int = SEQUENCE_LENGTH, keys: Sequence[str] = SESSION, features: Sequence[str] = STATE_FEATURES,
) -> DataFrame:
    """The checks of a prepared dataset, one row each, and `overall`; the last one looks for features named like a target."""
    columns = list(row_columns or [c for c in flows.columns if c not in (*keys, "flow_seq")])
    return audits.combine_checks(
        {
            "current_state": audits.label_check(flows),
            "timestamps": audits.timestamp_check(flows, keys=keys),
            "duplicates": audits.duplicate_check(flows, columns, keys=keys),
            "missing_data": audits.missing_check(flows),
            "windows": audits.window_check(states, window_seconds, keys),
            "features": audits.feature_check(states),
            "transitions": audits.transition_check(states, changes, keys),
            "sequences": audits.sequence_check(states, sequences, length, keys),
            "chronological_split": audits.split_order_check(split_sequences, keys),
            "leakage": audits.leakage_check(split_sequences, keys),
            "label_leakage": audits.label_leakage_check(features, states),
        }
    )


def dataset_summary(flows: DataFrame, states: DataFrame, sequences: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """One row: flow, window, transition and sequence counts, time span, and flows per class."""
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    rows = flows.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count(timestamp).alias("timestamps_valid"),
        (F.count(F.lit(1)) - F.count(timestamp)).alias("timestamps_invalid"),
        ((F.max(micros) - F.min(micros)) / 1_000_000).alias("span_seconds"),
    )
    windows = states.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"{c.lower()}_flow_count").alias(c) for c in STATE_CLASSES]
    ).agg(
        F.sum("_n").alias("total_windows"),
        F.sum(F.col("_n") - 1).alias("transitions"),
        *[F.sum(c).alias(f"{c.lower()}_flows") for c in STATE_CLASSES],
    )
    return audits.one_row(rows, windows, sequences.agg(F.count(F.lit(1)).alias("total_sequences")))


def insufficient_data(
    flows: DataFrame, states: DataFrame, length: int = SEQUENCE_LENGTH, window_seconds: int = WINDOW_SECONDS,
    keys: Sequence[str] = SESSION,
) -> DataFrame:
    """Sessions with too few windows for one sequence, with the span and counts that explain it."""
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    spans = flows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("flow_records"),
        F.count_if(F.col("current_state") == INVALID_STATE).alias("invalid_features"),
        ((F.max(micros) - F.min(micros)) / 1_000_000).alias("capture_seconds"),
    )
    counted = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("available_windows"))
    joined = spans.join(counted, list(keys), "left").withColumn(
        "available_windows", F.coalesce("available_windows", F.lit(0))
    )
    text = F.format_string(
        f"Insufficient temporal data: required windows {length + 1}, available windows %d, capture duration %.2f sec, "
        f"flow records %d, invalid features %d, window size {window_seconds} s, sequence length {length}.",
        "available_windows", "capture_seconds", "flow_records", "invalid_features",
    )
    short = joined.where(F.col("available_windows") < length + 1)
    return short.withColumns({"required_windows": F.lit(length + 1), "message": text})


def prepare_dataset(
    flows: DataFrame, output: str, window_seconds: int = WINDOW_SECONDS, length: int = SEQUENCE_LENGTH,
    state: str = "current_state", keys: Sequence[str] = SESSION,
) -> DataFrame:
    """Write states, transitions, sequences (whole and per split), scaler and summary under `output`.

    Each written table is read back by the steps after it, so a lost executor costs one step. Raises when the source
    has no usable timestamp or state column, when a gate fails, or when no session has training sequences.
    """
    spark = flows.sparkSession
    if state not in flows.columns:
        raise ValueError(f"Flows have no {state} column; label them first.")
    source_time = find_id_columns(flows.columns).get("timestamp")
    if source_time is None:
        raise ValueError("Flows have no timestamp column.")
    timed = parse_timestamps(flows, source_time, "_parsed").drop(source_time).withColumnRenamed("_parsed", "timestamp")
    window_states(timed, window_seconds, state, keys=keys).write.mode("overwrite").parquet(f"{output}/states")
    states = spark.read.parquet(f"{output}/states")
    if states.groupBy(*keys).count().where(F.col("count") > length).isEmpty():
        report = insufficient_data(timed, states, length, window_seconds, keys).orderBy(*keys).first()
        raise ValueError(report["message"] if report else "The source has no timed flows.")
    if "flow_seq" not in timed.columns:
        timed = timed.withColumn("flow_seq", F.monotonically_increasing_id())
    gates = audits.build_gates(timed, assign_windows(timed, window_seconds, keys=keys), states, keys=keys)
    failed = [row["gate"] for row in gates.where(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"Dataset gates failed: {failed}")
    transitions(states, keys).write.mode("overwrite").parquet(f"{output}/transitions")
    seq.sequences_positional(states, length, keys).write.mode("overwrite").parquet(f"{output}/sequences")
    splits.chronological_split(states, keys).write.mode("overwrite").partitionBy("split").parquet(f"{output}/split_states")
    parts = spark.read.parquet(f"{output}/split_states")
    scaler = splits.fit_min_max(parts.where(F.col("split") == "train"))
    scaler.save(spark, f"{output}/scaler")
    sequences = seq.sequences_positional(parts, length, keys, within=["split"]).withColumns(
        {
            "X_scaled": scaler.transform_vectors(F.col("X"), STATE_FEATURES),
            "y_state_vector_scaled": scaler.transform_vectors(F.array("y_state_vector"), STATE_FEATURES)[0],
        }
    )
    sequences.write.mode("overwrite").partitionBy("split").parquet(f"{output}/split_sequences")
    written = spark.read.parquet(f"{output}/split_sequences")
    if written.where(F.col("split") == "train").isEmpty():
        raise ValueError("The training split has no usable sequence; provide a longer capture or shorter sequences.")
    summary = dataset_summary(timed, states, spark.read.parquet(f"{output}/sequences"))
    summary.write.mode("overwrite").json(f"{output}/summary")
    return spark.read.json(f"{output}/summary")


def load_dataset(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    names = ("states", "transitions", "sequences", "split_states", "split_sequences")
    return {name: spark.read.parquet(f"{output}/{name}") for name in names}
