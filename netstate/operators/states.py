"""Time windows and the network-state vector of each window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.constants import (
    ALERT_CLASSES, ATTACK_CLASSES, FLOW_FEATURES, PROXY_WINDOW_ROWS, STATE_CLASSES, STATE_FEATURES, WINDOW_AGGREGATES,
    WINDOW_SECONDS,
)
from netstate.functions.columns import column_signature, find_id_columns, quoted
from netstate.functions.values import argmax_label
from netstate.scale import ROW_BITS, join_small, with_position

SESSION = ("session_id",)
DST_PORT = " Destination Port"
ENDPOINTS = ["unique_src_ip_count", "unique_dst_ip_count", "unique_src_port_count", "unique_dst_port_count"]

# Raw cells as numbers: NaN and text are missing; row-order windows also treat infinities as missing.
ANY_NUMBER = "nullif(try_cast({c} AS DOUBLE), double('NaN'))"
FINITE_NUMBER = "CASE WHEN abs(try_cast({c} AS DOUBLE)) < double('Infinity') THEN try_cast({c} AS DOUBLE) END"


def assign_windows(
    flows: DataFrame, window_seconds: int = WINDOW_SECONDS, timestamp: str = "timestamp",
    keys: Sequence[str] = SESSION,
) -> DataFrame:
    """Add window_id, window_start and window_end: half-open windows counted from the first flow of the session.

    Rows without a timestamp are left out. Start times are one row per session and joined behind a size check.
    """
    width = window_seconds * 1_000_000
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    timed = flows.where(F.col(timestamp).isNotNull())
    first = timed.groupBy(*keys).agg(F.min(micros).alias("_t0"))
    windowed = join_small(timed, first, keys, "inner")
    window_id = F.floor((micros - F.col("_t0")) / F.lit(width))
    start = F.col("_t0") + F.col("window_id") * width
    return (
        windowed.withColumn("window_id", window_id)
        .withColumn("window_start", F.timestamp_micros(start))
        .withColumn("window_end", F.timestamp_micros(start + width))
        .drop("_t0")
    )


def window_source_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """Feature name or id role -> column of the flow table; only the features that windows use are required."""
    by_signature: dict[tuple[str, ...], str] = {}
    for column in columns:
        by_signature.setdefault(column_signature(column), column)
    aliases = {" Average Packet Size": ["Pkt Size Avg"], " Max Packet Length": ["Pkt Len Max"]}
    needed = dict.fromkeys([DST_PORT, *[feature for _, feature, _ in WINDOW_AGGREGATES]])
    found: dict[str, str | None] = {}
    for feature in needed:
        names = [feature, *aliases.get(feature, [])]
        found[feature] = next((by_signature[s] for s in map(column_signature, names) if s in by_signature), None)
    missing = [feature for feature, column in found.items() if column is None and feature in FLOW_FEATURES]
    if missing:
        raise ValueError(f"Flow columns needed for window states not found: {missing}")
    roles = find_id_columns(columns)
    for role in ("src_ip", "dst_ip", "src_port"):
        found[role] = roles.get(role)
    return found


def _aggregates(source: dict, state: str, number: str) -> list[Column]:
    """Additive part of the state vector and class counts. `number` is the SQL form of a cleaned raw column."""
    functions = {"sum": "sum", "mean": "avg", "min": "min", "max": "max", "var": "var_samp"}
    columns = [F.expr("count(1) AS flow_count")]
    for output, feature, how in WINDOW_AGGREGATES:
        value = number.format(c=quoted(source[feature]))
        columns.append(F.expr(f"coalesce({functions[how]}({value}), 0D) AS {output}"))
    columns += [F.expr(f"count_if({quoted(state)} = '{c}') AS {c.lower()}_flow_count") for c in STATE_CLASSES]
    return columns


def _endpoint_counts(windowed: DataFrame, source: dict, keys: Sequence[str]) -> DataFrame:
    """Distinct addresses and ports per window."""
    kinds = ["src_ip", "dst_ip", "src_port", DST_PORT]
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("kind"), F.col(quoted(source[kind])).cast("string").alias("value"))
            for i, kind in enumerate(kinds)
            if source[kind]
        ]
    )
    distinct = windowed.select(*keys, F.inline(pairs)).where(F.col("value").isNotNull()).groupBy(*keys, "kind", "value")
    return distinct.agg(F.lit(1).alias("_one")).groupBy(*keys).agg(
        *[F.count_if(F.col("kind") == i).cast("double").alias(name) for i, name in enumerate(ENDPOINTS)]
    )


def _endpoint_sets(source: dict) -> list[Column]:
    """Distinct addresses and ports of a window of few rows."""
    sizes = {
        name: f"size(collect_set({quoted(source[kind])}))" if source[kind] else "0"
        for name, kind in zip(ENDPOINTS, ("src_ip", "dst_ip", "src_port", DST_PORT))
    }
    return [F.expr(f"CAST({size} AS DOUBLE) AS {name}") for name, size in sizes.items()]


def _finish(states: DataFrame, seconds: float) -> DataFrame:
    """Derived totals, rates, dominant state and attack flags; windows without a scoreable flow are dropped."""
    counts = {c: F.col(f"{c.lower()}_flow_count") for c in STATE_CLASSES}
    attacks = [counts[c] for c in ATTACK_CLASSES]
    scoreable = sum(counts.values(), F.lit(0))
    attacked = sum(attacks, F.lit(0)) > 0
    packets = F.col("total_fwd_packets") + F.col("total_bwd_packets")
    volume = F.col("total_fwd_bytes") + F.col("total_bwd_bytes")
    return (
        states.withColumn("scoreable_flow_count", scoreable)
        .where(F.col("scoreable_flow_count") > 0)
        .withColumns(
            {
                "flow_count": F.col("flow_count").cast("double"),
                "total_packets": packets,
                "total_bytes": volume,
                "packets_per_second": packets / seconds,
                "bytes_per_second": volume / seconds,
                "flows_per_second": F.col("flow_count") / seconds,
                "dominant_state": argmax_label(list(counts.values()), STATE_CLASSES),
                "attack_present": attacked.cast("int"),
                "alert_state": F.when(attacked, argmax_label(attacks, ATTACK_CLASSES)).otherwise(ALERT_CLASSES[0]),
            }
        )
    )


def window_states(
    flows: DataFrame, window_seconds: int = WINDOW_SECONDS, state: str = "current_state",
    timestamp: str = "timestamp", keys: Sequence[str] = SESSION,
) -> DataFrame:
    """One state vector per session and time window.

    Sums and extremes are combined map-side, so a window or session that holds most of the flows reaches its reducer
    as partial results. Endpoints are counted exactly from narrow (window, kind, value) rows that are made distinct
    first; the numeric and the endpoint branch read different columns of the flows, and both end up partitioned by
    window, so joining them moves nothing.
    """
    source = window_source_columns(flows.columns)
    windowed = assign_windows(flows, window_seconds, timestamp, keys)
    aggregated = windowed.groupBy(*keys, "window_id").agg(
        F.min("window_start").alias("window_start"),
        F.min("window_end").alias("window_end"),
        *_aggregates(source, state, ANY_NUMBER),
    )
    endpoints = _endpoint_counts(windowed, source, [*keys, "window_id"])
    joined = aggregated.join(endpoints, [*keys, "window_id"], "left")
    joined = joined.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in ENDPOINTS})
    counts = [f"{c.lower()}_flow_count" for c in STATE_CLASSES]
    return _finish(joined, window_seconds).select(
        *keys, "window_id", "window_start", "window_end", *STATE_FEATURES, *counts, "dominant_state", "attack_present",
        "alert_state",
    )


def proxy_windows(
    flows: DataFrame, state: Column, order: str = "flow_seq", window_rows: int = PROXY_WINDOW_ROWS,
    keys: Sequence[str] = SESSION, bits: int = ROW_BITS,
) -> DataFrame:
    """Windows of `window_rows` consecutive rows per session, for exports without timestamps.

    Infinities count as missing here. A window holds at most `window_rows` flows, so its distinct values are
    gathered as sets.
    """
    source = window_source_columns(flows.columns)
    used = dict.fromkeys([*keys, order, *[c for c in source.values() if c]])
    prepared = flows.withColumn("_state", state).select(*[F.col(quoted(c)) for c in used], "_state")
    numbered = with_position(prepared, keys, order, bits, "_row")
    window_id = F.floor((F.col("_row") - 1) / window_rows).cast("long")
    aggregated = numbered.groupBy(*keys, window_id.alias("window_id")).agg(
        *_aggregates(source, "_state", FINITE_NUMBER), *_endpoint_sets(source)
    )
    counts = [f"{c.lower()}_flow_count" for c in STATE_CLASSES]
    start = F.col("window_id") * window_rows
    return _finish(aggregated, window_rows).select(
        *keys, "window_id", *STATE_FEATURES, "scoreable_flow_count", *counts, "dominant_state", "attack_present",
        "alert_state", start.alias("proxy_start_row"), (start + window_rows).alias("proxy_end_row"),
    )


def state_totals(states: DataFrame) -> DataFrame:
    """Flows per class over all windows."""
    totals = states.agg(*[F.sum(f"{c.lower()}_flow_count").alias(c) for c in STATE_CLASSES])
    return totals.unpivot([], STATE_CLASSES, "state", "flow_count")
