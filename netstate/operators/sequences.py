"""Fixed-length histories of window states with their targets.

Frames are built inside chunks of consecutive order values whose borders are repeated in the neighbouring chunk, so a
session is spread over as many tasks as it has chunks and no frame is longer than history plus targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netstate.constants import HORIZONS, SEQUENCE_LENGTH, STATE_CLASSES, STATE_FEATURES
from netstate.functions.values import encode_label
from netstate.scale import WINDOW_BITS, with_halo, with_position

SESSION = ("session_id",)


def _frames(
    states: DataFrame, keys: Sequence[str], order: str, history: int, future: int, item: Column, bits: int
) -> DataFrame:
    """`_past` (the row and its predecessors) and `_next` for every row with a full run of consecutive order values."""
    chunked = with_halo(states, order, history - 1, future, bits).withColumn("_item", item)
    frame = Window.partitionBy(*keys, "_chunk").orderBy(order)
    first = F.first(order).over(frame.rowsBetween(-(history - 1), 0))
    last = F.last(order).over(frame.rowsBetween(1, future))
    return (
        chunked.withColumns(
            {
                "_first": first,
                "_last": last,
                "_past": F.collect_list("_item").over(frame.rowsBetween(-(history - 1), 0)),
                "_next": F.collect_list("_item").over(frame.rowsBetween(1, future)),
            }
        )
        .where(F.col("_owned"))
        .where((F.size("_past") == history) & (F.size("_next") == future))
        .where((F.col("_first") == F.col(order) - (history - 1)) & (F.col("_last") == F.col(order) + future))
    )


def _alert(states: DataFrame) -> Column:
    if "alert_state" in states.columns:
        return F.col("alert_state")
    return F.when(F.col("dominant_state") == "BENIGN", F.lit("NONE")).otherwise(F.col("dominant_state"))


def _item(states: DataFrame, features: Sequence[str]) -> Column:
    attack = F.col("attack_present") if "attack_present" in states.columns else F.lit(None).cast("int")
    return F.struct(
        F.col("window_id").cast("long").alias("window_id"),
        F.col("dominant_state").alias("state"),
        _alert(states).alias("alert"),
        attack.alias("attack"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("features"),
    )


def sequences_positional(
    states: DataFrame, length: int = SEQUENCE_LENGTH, keys: Sequence[str] = SESSION,
    features: Sequence[str] = STATE_FEATURES, within: Sequence[str] = (), bits: int = WINDOW_BITS,
) -> DataFrame:
    """Sequences over existing windows in order, gaps allowed: N - length per session (and per `within` group).

    `within` names columns, e.g. a split, that a sequence may not cross; each group must be a range of windows.
    """
    groups = [*keys, *within]
    numbered = with_position(states, groups, "window_id", bits)
    framed = _frames(numbered, groups, "position", length, 1, _item(states, features), bits)
    target = F.get("_next", F.lit(0))
    return framed.select(
        *groups,
        F.col("_past.window_id").alias("input_window_ids"),
        F.col("_past.features").alias("X"),
        target["window_id"].alias("target_window_id"),
        target["state"].alias("y_dominant_state"),
        target["attack"].alias("y_attack_present"),
        target["features"].alias("y_state_vector"),
    )


def sequences_gap_aware(
    states: DataFrame, length: int = SEQUENCE_LENGTH, keys: Sequence[str] = SESSION,
    features: Sequence[str] = STATE_FEATURES, within: Sequence[str] = (), bits: int = WINDOW_BITS,
) -> DataFrame:
    """Sequences whose input and target windows are consecutive ids; none bridges a gap or a session border."""
    groups = [*keys, *within]
    framed = _frames(states, groups, "window_id", length, 1, _item(states, features), bits)
    target = F.get("_next", F.lit(0))
    return framed.select(
        *groups,
        F.col("_past.window_id").alias("input_window_ids"),
        F.col("_past.state").alias("input_labels"),
        F.col("_past.alert").alias("input_alert_labels"),
        F.col("_past.features").alias("X"),
        target["window_id"].alias("target_window_id"),
        target["state"].alias("y_dominant_state"),
        target["alert"].alias("y_attack_alert"),
        target["features"].alias("y_state_vector"),
    )


def multistep_sequences(
    states: DataFrame, length: int = SEQUENCE_LENGTH, horizons: int = HORIZONS, keys: Sequence[str] = SESSION,
    features: Sequence[str] = STATE_FEATURES, within: Sequence[str] = (), bits: int = WINDOW_BITS,
) -> DataFrame:
    """History of `length` windows with the next `horizons` states, all consecutive and all of the four states."""
    groups = [*keys, *within]
    framed = _frames(states, groups, "window_id", length, horizons, _item(states, features), bits)
    known = F.array(*[F.lit(c) for c in STATE_CLASSES])
    labels = F.concat(F.col("_past.state"), F.col("_next.state"))
    framed = framed.where(F.size(F.array_except(labels, known)) == 0).where(~F.exists(labels, lambda s: s.isNull()))
    past, ahead = F.col("_past.window_id"), F.col("_next.window_id")
    sample = F.concat_ws(":", *[F.col(k) for k in keys], F.get(past, F.lit(0)), F.get(ahead, F.lit(horizons - 1)))
    return framed.select(
        *groups,
        sample.alias("sample_id"),
        past.alias("history_window_ids"),
        ahead.alias("target_window_ids"),
        F.col("_past.state").alias("input_labels"),
        F.col("_past.alert").alias("input_alert_labels"),
        F.col("_next.state").alias("y_dominant"),
        F.col("_next.alert").alias("y_alert"),
        F.col("_past.features").alias("X"),
    )


def next_state_pairs(
    states: DataFrame, length: int = SEQUENCE_LENGTH, keys: Sequence[str] = SESSION,
    features: Sequence[str] = STATE_FEATURES, bits: int = WINDOW_BITS,
) -> DataFrame:
    """(history, next class index, next state vector) for a rollout model."""
    sequences = sequences_gap_aware(states, length, keys, features, bits=bits)
    return sequences.select(
        *keys,
        "target_window_id",
        "X",
        encode_label(F.col("y_dominant_state"), STATE_CLASSES).alias("y_class"),
        F.col("y_state_vector").alias("y_state"),
    ).where(F.col("y_class").isNotNull())


def recent_windows(states: DataFrame, length: int = SEQUENCE_LENGTH, keys: Sequence[str] = SESSION) -> DataFrame:
    """The last `length` windows of each session that has them without a gap."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("window_id"))
    tail = states.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= length)
    whole = Window.partitionBy(*keys)
    return (
        tail.withColumn("_span", F.max("window_id").over(whole) - F.min("window_id").over(whole))
        .withColumn("_rows", F.count(F.lit(1)).over(whole))
        .where((F.col("_rows") == length) & (F.col("_span") == length - 1))
        .drop("_rank", "_span", "_rows")
    )


def require_windows(states: DataFrame, length: int = SEQUENCE_LENGTH, keys: Sequence[str] = SESSION) -> DataFrame:
    """Sessions too short for one sequence, with the number of windows they need."""
    counted = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("available_windows"))
    return counted.where(F.col("available_windows") < length + 1).withColumn("required_windows", F.lit(length + 1))
