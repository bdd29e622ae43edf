"""State transitions, contiguous blocks, attack runs and order audits over window states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netstate.constants import STATE_CLASSES, WINDOW_SECONDS
from netstate.scale import ROW_BITS, WINDOW_BITS, bucket_of, with_next, with_position, with_previous

SESSION = ("session_id",)


def transitions(states: DataFrame, keys: Sequence[str] = SESSION, bits: int = WINDOW_BITS) -> DataFrame:
    """Each window with the next existing window of its session, across gaps."""
    carried = ["window_id", "dominant_state", "attack_present", "window_start"]
    paired = with_next(states.select(*keys, *carried), keys, "window_id", carried, "next_", bits)
    delta = (F.unix_micros("next_window_start") - F.unix_micros("window_start")) / 1_000_000
    return paired.where(F.col("next_window_id").isNotNull()).select(
        *keys,
        F.col("window_id").alias("current_window"),
        F.col("next_window_id").alias("next_window"),
        F.col("dominant_state").alias("current_state"),
        F.col("next_dominant_state").alias("next_state"),
        F.col("attack_present").alias("current_attack_present"),
        F.col("next_attack_present"),
        delta.alias("time_delta_seconds"),
    )


def transition_counts(changes: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent state pairs."""
    counted = changes.groupBy("current_state", "next_state").agg(F.count(F.lit(1)).alias("transitions"))
    return counted.orderBy(F.desc("transitions"), "current_state", "next_state").limit(limit)


def contiguous_blocks(states: DataFrame, keys: Sequence[str] = SESSION, bits: int = WINDOW_BITS) -> DataFrame:
    """Maximal runs of consecutive window ids per session."""
    numbered = with_position(states.select(*keys, "window_id"), keys, "window_id", bits)
    islands = numbered.groupBy(*keys, (F.col("window_id") - F.col("position")).alias("_island"))
    return islands.agg(
        F.min("window_id").alias("start_window"),
        F.max("window_id").alias("end_window"),
        F.count(F.lit(1)).alias("windows"),
    ).drop("_island")


def attack_runs(
    states: DataFrame, window_seconds: int = WINDOW_SECONDS, keys: Sequence[str] = SESSION, bits: int = WINDOW_BITS
) -> DataFrame:
    """Runs of consecutive windows that share one attack state."""
    attacks = states.where(F.col("dominant_state") != "BENIGN").select(*keys, "window_id", "dominant_state")
    numbered = with_position(attacks, [*keys, "dominant_state"], "window_id", bits)
    island = (F.col("window_id") - F.col("position")).alias("_island")
    runs = numbered.groupBy(*keys, "dominant_state", island).agg(
        F.min("window_id").alias("start_window"),
        F.max("window_id").alias("end_window"),
        F.count(F.lit(1)).alias("windows"),
    )
    return runs.select(
        *keys,
        F.col("dominant_state").alias("state"),
        "start_window",
        "end_window",
        "windows",
        (F.col("start_window") * window_seconds).alias("proxy_start_seconds"),
        ((F.col("end_window") + 1) * window_seconds).alias("proxy_end_seconds"),
    )


def window_audit(
    states: DataFrame, window_seconds: int, keys: Sequence[str] = SESSION, bits: int = WINDOW_BITS
) -> DataFrame:
    """Per session: windows of wrong length, repeated ids, missing ids and overlapping starts."""
    width = window_seconds * 1_000_000
    unique = states.groupBy(*keys, "window_id").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.min(F.unix_micros("window_start")).alias("_first_start"),
        F.max(F.unix_micros("window_start")).alias("_last_start"),
        F.count_if(F.unix_micros("window_end") - F.unix_micros("window_start") != width).alias("_bad"),
    )
    linked = with_previous(unique, keys, "window_id", ["window_id", "_last_start"], "prev_", bits)
    # Copies of one id start together or nearly so: each copy after the first overlaps its predecessor.
    overlapping = F.col("_copies") - 1 + (F.col("_first_start") - F.col("prev__last_start") < width).cast("int")
    return linked.groupBy(*keys).agg(
        F.sum("_copies").alias("total_windows"),
        F.sum("_bad").alias("bad_duration_windows"),
        F.coalesce(F.sum(F.col("window_id") - F.col("prev_window_id") - 1), F.lit(0)).alias("missing_windows"),
        F.sum(F.col("_copies") - 1).alias("duplicate_window_ids"),
        F.sum(F.coalesce(overlapping, F.col("_copies") - 1)).alias("overlapping_windows"),
    )


def order_audit(
    flows: DataFrame, order: str = "flow_seq", timestamp: str = "timestamp", keys: Sequence[str] = SESSION,
    bits: int = ROW_BITS,
) -> DataFrame:
    """Per session: timed rows and rows whose timestamp lies before that of the preceding timed row in source order.

    Inversions inside an order bucket come from a bucket-local window; one (first, last) pair per bucket covers the
    borders.
    """
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    timed = flows.where(F.col(timestamp).isNotNull()).select(
        *keys, F.col(order).alias("_order"), micros.alias("_ts"), bucket_of(order, bits).alias("_bucket")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_order")
    inverted = (F.col("_ts") < F.lag("_ts").over(inside)).cast("int")
    buckets = (
        timed.withColumn("_inverted", F.coalesce(inverted, F.lit(0)))
        .groupBy(*keys, "_bucket")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.sum("_inverted").alias("_inverted"),
            F.min_by("_ts", "_order").alias("_first"),
            F.max_by("_ts", "_order").alias("_last"),
        )
    )
    across = F.col("_first") < F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))
    return (
        buckets.withColumn("_across", F.coalesce(across.cast("int"), F.lit(0)))
        .groupBy(*keys)
        .agg(F.sum("_rows").alias("valid_rows"), F.sum(F.col("_inverted") + F.col("_across")).alias("out_of_order_rows"))
    )


def packet_rates(
    samples: DataFrame, time: str = "ts_ms", counter: str = "packets", keys: Sequence[str] = (), bits: int = ROW_BITS
) -> DataFrame:
    """Packets per second between successive counter samples; 0 when the clock or the counter did not advance."""
    linked = with_previous(samples.select(*keys, time, counter), keys, time, [time, counter], "prev_", bits)
    seconds = (F.col(time) - F.col(f"prev_{time}")) / 1000
    gained = F.col(counter) - F.col(f"prev_{counter}")
    rate = F.when((seconds > 0) & (gained >= 0), gained / seconds).otherwise(F.lit(0.0))
    return linked.where(F.col(f"prev_{time}").isNotNull()).select(*keys, time, rate.alias("packets_per_second"))


def chronological_position(
    rows: DataFrame, time: str, order: str, keys: Sequence[str] = SESSION, position: str = "place", bits: int = 32
) -> DataFrame:
    """Stable chronological place of every row of its session: by time, equal times in the order of `order`.

    Rows without a time come first. Buckets are 2**bits microseconds long (about 72 minutes).
    """
    timed = rows.withColumn("_micros", F.unix_micros(F.col(time).cast("timestamp")))
    return with_position(timed, keys, "_micros", bits, position, ties=[order]).drop("_micros")


def join_predictions(
    truth: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("session_id", "flow_seq"), label: str = "y_true",
    predicted: str = "y_pred", classes: Sequence[str] = tuple(STATE_CLASSES),
) -> DataFrame:
    """Rows that both tables label with one of the classes, by session and row number."""
    left = truth.where(F.col(label).isin(list(classes))).select(*keys, label)
    right = predictions.where(F.col(predicted).isin(list(classes))).select(*keys, predicted)
    return left.join(right, list(keys))
