"""Cross-flow attack signatures: floods per second and victim, SYN floods, port sweeps, and the capture verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.constants import (
    ATTACK_CLASSES, FLOOD_BUCKET_SECONDS, FLOOD_MAX_TOP_SOURCE_SHARE, FLOOD_MIN_PACKET_RATE, FLOOD_MIN_SOURCES,
    FLOOD_MIN_VICTIM_SHARE, MIN_ATTACK_RATIO, STATE_CLASSES, SWEEP_MAX_MEAN_FWD_BYTES, SWEEP_MIN_PORTS,
    SYN_MAX_ACK_RATIO, SYN_MIN_COUNT, SYN_MIN_PACKET_RATE,
)
from netstate.functions.values import argmax_label, number_or_zero
from netstate.scale import ROW_BITS, bounded_rows, join_small, salted_join, with_previous

TIME_COLUMNS = ("timestamp", "time", "starttime")


def _column(flows: DataFrame, name: str) -> Column | None:
    real = next((c for c in flows.columns if c.strip().lower() == name), None)
    return F.col(f"`{real}`") if real is not None else None


def _amount(flows: DataFrame, name: str) -> Column:
    column = _column(flows, name)
    return F.lit(0.0) if column is None else number_or_zero(column)


def _time(flows: DataFrame) -> Column | None:
    found = next((c for c in (_column(flows, name) for name in TIME_COLUMNS) if c is not None), None)
    return None if found is None else found.try_cast("timestamp")


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("nan"))


def _bucket(time: Column, seconds: int) -> Column:
    width = seconds * 1_000_000
    return F.floor(F.unix_micros(time) / F.lit(width)) * F.lit(width)


def flood_evidence(
    flows: DataFrame, bucket_seconds: int = FLOOD_BUCKET_SECONDS, min_sources: int = FLOOD_MIN_SOURCES,
    min_victim_share: float = FLOOD_MIN_VICTIM_SHARE, max_top_share: float = FLOOD_MAX_TOP_SOURCE_SHARE,
    min_packet_rate: float = FLOOD_MIN_PACKET_RATE, min_syn: float = SYN_MIN_COUNT,
    max_ack_ratio: float = SYN_MAX_ACK_RATIO,
) -> DataFrame:
    """Source and victim concentration of every (time bucket, victim), with the flood state it fires, if any.

    Flows are first combined per (bucket, victim, source), so a victim that receives most of the traffic is spread
    over its sources, and its per-source sums are combined again before they meet in one group.
    """
    victim, source, time = _column(flows, "dst_ip"), _column(flows, "src_ip"), _time(flows)
    if victim is None or source is None or time is None:
        raise ValueError("Flood evidence needs source, destination and time columns.")
    rows = flows.where(time.isNotNull()).select(
        _bucket(time, bucket_seconds).alias("bucket_us"),
        victim.cast("string").alias("victim"),
        _text(source).alias("source"),
        (_amount(flows, "tot_fwd_pkts") + _amount(flows, "tot_bwd_pkts")).alias("packets"),
        _amount(flows, "syn_flag_cnt").alias("syn"),
        _amount(flows, "ack_flag_cnt").alias("ack"),
    )
    per_source = rows.where(F.col("victim").isNotNull()).groupBy("bucket_us", "victim", "source").agg(
        F.count(F.lit(1)).alias("flows"), *[F.sum(c).alias(c) for c in ("packets", "syn", "ack")]
    )
    per_victim = per_source.groupBy("bucket_us", "victim").agg(
        F.count(F.lit(1)).alias("unique_sources"),
        F.max("flows").alias("top_flows"),
        *[F.sum(c).alias(c) for c in ("flows", "packets", "syn", "ack")],
    )
    totals = rows.groupBy("bucket_us").agg(F.count(F.lit(1)).alias("bucket_flows"))
    victim_share = F.col("flows") / F.col("bucket_flows")
    top_share = F.col("top_flows") / F.col("flows")
    rate = F.col("packets") / F.lit(float(bucket_seconds))
    ack_ratio = F.when(F.col("syn") != 0, F.col("ack") / F.col("syn"))
    spread = (F.col("unique_sources") >= min_sources) & (victim_share >= min_victim_share) & (top_share <= max_top_share)
    single = (
        (F.col("unique_sources") == 1)
        & (F.col("syn") >= min_syn)
        & (F.coalesce(ack_ratio, F.lit(1.0)) <= max_ack_ratio)
    )
    state = F.when(rate >= min_packet_rate, F.when(spread, F.lit("DDoS")).when(single, F.lit("DoS")))
    return join_small(per_victim, totals, ["bucket_us"], "inner").select(
        F.timestamp_micros("bucket_us").alias("window_start"),
        "victim",
        "unique_sources",
        F.col("flows").alias("flow_count"),
        F.round(victim_share, 4).alias("victim_flow_ratio"),
        F.round(top_share, 4).alias("top_source_flow_ratio"),
        F.round(rate, 4).alias("packet_rate"),
        F.round("syn", 4).alias("syn_count"),
        F.round(ack_ratio, 4).alias("ack_to_syn_ratio"),
        state.alias("state"),
    )


def is_syn_flood(
    flows: DataFrame, min_syn: float = SYN_MIN_COUNT, max_ack_ratio: float = SYN_MAX_ACK_RATIO,
    min_packet_rate: float = SYN_MIN_PACKET_RATE,
) -> Column:
    """Half-open flood within one flow."""
    syn, ack = _amount(flows, "syn_flag_cnt"), _amount(flows, "ack_flag_cnt")
    return (syn >= min_syn) & (ack <= syn * max_ack_ratio) & (_amount(flows, "flow_pkts_s") >= min_packet_rate)


def port_sweeps(
    flows: DataFrame, order: str = "flow_seq", min_ports: int = SWEEP_MIN_PORTS,
    max_mean_bytes: float = SWEEP_MAX_MEAN_FWD_BYTES, bits: int = ROW_BITS, sessions: Sequence[str] = (),
) -> DataFrame:
    """(source, destination) pairs that touch many ports with tiny probes, and the way they walk the ports.

    Contacts of several sessions stand in the order of the columns `sessions` (such as session_rank) and then of `order`.
    """
    pairs = flows.select(
        _text(_column(flows, "src_ip")).alias("src"),
        _text(_column(flows, "dst_ip")).alias("dst"),
        F.when(_amount(flows, "dst_port") > 0, _amount(flows, "dst_port").cast("long")).alias("port"),
        _amount(flows, "totlen_fwd_pkts").alias("fwd_bytes"),
        F.col(order).alias("_order"),
        *sessions,
    )
    swept = (
        pairs.groupBy("src", "dst")
        .agg(
            F.count_distinct("port").alias("unique_ports"),
            F.count(F.lit(1)).alias("flow_count"),
            F.avg("fwd_bytes").alias("mean_fwd_bytes"),
        )
        .where((F.col("unique_ports") >= min_ports) & (F.col("mean_fwd_bytes") <= max_mean_bytes))
    )
    pair, touched = ["src", "dst"], pairs.where(F.col("port").isNotNull())
    local = bounded_rows(swept)
    if local is not None:
        swept = local
        suspects = touched.join(F.broadcast(local.select(*pair)), pair, "left_semi")
    else:
        suspects = salted_join(touched, swept.select(*pair), pair, "inner")
    walked = port_walks(suspects, pair, "_order", "port", bits, sessions)
    return swept.join(walked, pair, "left").withColumn("pattern", F.coalesce("pattern", F.lit("none")))


def walk_pattern(distinct: Column, low: Column, high: Column, steps: Column, unit: Column, small: Column, large: Column,
                 min_distinct: int = 3) -> Column:
    """How ports were walked, from counts over the walk.

    `steps` is the number of steps between successive ports, `unit` how many of them have size 1, `small` and `large`
    the extreme step sizes.
    """
    return (
        F.when(distinct < min_distinct, F.lit("none"))
        .when(high - low + 1 == distinct, F.lit("sequential"))
        .when((steps > 0) & (unit / steps >= 0.6), F.lit("sequential"))
        .when((steps > 0) & (small == large) & (large > 1), F.lit("strided"))
        .otherwise(F.lit("randomised"))
    )


def port_walks(
    contacts: DataFrame, keys: Sequence[str], order: str, port: str = "port", bits: int = ROW_BITS,
    sessions: Sequence[str] = (),
) -> DataFrame:
    """Walk pattern per key over positive ports in contact order, `sessions` before `order`.

    Steps are formed inside order buckets with one carried port per bucket, then reduced to counts: a pair that owns
    most of the flows is never gathered.
    """
    stepped = with_previous(contacts.select(*keys, *sessions, order, port), keys, order, [port], "prev_", bits, sessions)
    step = F.abs(F.col(port) - F.col(f"prev_{port}"))
    return (
        stepped.withColumn("_step", step)
        .groupBy(*keys)
        .agg(
            F.count_distinct(port).alias("_distinct"),
            F.min(port).alias("_low"),
            F.max(port).alias("_high"),
            F.count("_step").alias("_steps"),
            F.count_if(F.col("_step") == 1).alias("_unit"),
            F.min("_step").alias("_small"),
            F.max("_step").alias("_large"),
        )
        .select(
            *keys,
            walk_pattern(
                *[F.col(c) for c in ("_distinct", "_low", "_high", "_steps", "_unit", "_small", "_large")]
            ).alias("pattern"),
        )
    )


def signature_states(
    flows: DataFrame, flood: Mapping[str, float] | None = None, syn: Mapping[str, float] | None = None,
    sweep: Mapping[str, float] | None = None, order: str = "flow_seq",
) -> DataFrame:
    """Every flow with `signature_state`: flood state of its bucket and victim, else SYN flood, else port sweep.

    A rule whose columns are absent does not fire.
    """
    flood, syn, sweep = dict(flood or {}), dict(syn or {}), dict(sweep or {})
    columns = flows.columns
    seconds = int(flood.get("bucket_seconds", FLOOD_BUCKET_SECONDS))
    src, dst, time = _column(flows, "src_ip"), _column(flows, "dst_ip"), _time(flows)
    flooded, swept = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    rows = flows.withColumn("_syn_flood", is_syn_flood(flows, **syn))
    if src is not None and dst is not None and time is not None:
        fired = flood_evidence(flows, **flood).where(F.col("state").isNotNull())
        fired = fired.select(
            F.unix_micros("window_start").alias("_bucket_us"), F.col("victim").alias("_dst"),
            F.col("state").alias("_flood_state"),
        )
        rows = rows.withColumns({"_bucket_us": _bucket(time, seconds), "_dst": dst.cast("string")})
        rows = join_small(rows, fired, ["_bucket_us", "_dst"])
        flooded = F.col("_flood_state")
    if src is not None and dst is not None and _column(flows, "dst_port") is not None:
        pairs = _swept_pairs(flows, **sweep).withColumn("_swept", F.lit(True))
        rows = rows.withColumns({"_src_text": _text(src), "_dst_text": _text(dst)})
        rows = join_small(rows, pairs, ["_src_text", "_dst_text"])
        swept = F.col("_swept")
    state = F.coalesce(
        flooded,
        F.when(F.col("_syn_flood"), F.lit("DoS")),
        F.when(swept, F.lit("PortScan")),
        F.lit("BENIGN"),
    )
    return rows.withColumn("signature_state", state).select(*[F.col(f"`{c}`") for c in columns], "signature_state")


def _swept_pairs(
    flows: DataFrame, min_ports: int = SWEEP_MIN_PORTS, max_mean_bytes: float = SWEEP_MAX_MEAN_FWD_BYTES
) -> DataFrame:
    port = _amount(flows, "dst_port")
    grouped = flows.groupBy(
        _text(_column(flows, "src_ip")).alias("_src_text"), _text(_column(flows, "dst_ip")).alias("_dst_text")
    ).agg(
        F.count_distinct(F.when(port > 0, port.cast("long"))).alias("_ports"),
        F.avg(_amount(flows, "totlen_fwd_pkts")).alias("_bytes"),
    )
    wanted = (F.col("_ports") >= min_ports) & (F.col("_bytes") <= max_mean_bytes)
    return grouped.where(wanted).select("_src_text", "_dst_text")


def signature_hits(
    flows: DataFrame, flood: Mapping[str, float] | None = None, syn: Mapping[str, float] | None = None,
    sweep: Mapping[str, float] | None = None, order: str = "flow_seq",
) -> DataFrame:
    """One row per fired rule: rule, state, detail text and number of flows."""
    evidence = flood_evidence(flows, **dict(flood or {})).where(F.col("state").isNotNull())
    ddos = F.col("state") == "DDoS"
    floods = evidence.select(
        F.when(ddos, F.lit("rolling-source-fanin-flood")).otherwise(F.lit("rolling-single-source-syn-flood")).alias("rule"),
        "state",
        F.when(
            ddos,
            F.format_string(
                "%d concurrent sources -> %s at %.0f observed packets/s", "unique_sources", "victim", F.bround("packet_rate")
            ),
        )
        .otherwise(F.format_string("single source -> %s at %.0f observed packets/s", "victim", F.bround("packet_rate")))
        .alias("detail"),
        "flow_count",
    )
    limits = {"min_syn": SYN_MIN_COUNT, "min_packet_rate": SYN_MIN_PACKET_RATE, **dict(syn or {})}
    half_open = flows.agg(F.count_if(is_syn_flood(flows, **dict(syn or {}))).alias("flow_count"))
    half_open = half_open.where(F.col("flow_count") > 0).select(
        F.lit("syn-flood").alias("rule"),
        F.lit("DoS").alias("state"),
        F.format_string(
            f"%d flow(s) with SYN>={limits['min_syn']}, few ACKs, >={limits['min_packet_rate']:.0f} pkts/s", "flow_count"
        ).alias("detail"),
        "flow_count",
    )
    sweeps = port_sweeps(flows, order, **dict(sweep or {})).select(
        F.lit("port-sweep").alias("rule"),
        F.lit("PortScan").alias("state"),
        F.format_string(
            "%s -> %s: %d distinct ports, %s order, %.0f avg fwd bytes", "src", "dst", "unique_ports", "pattern",
            F.bround("mean_fwd_bytes"),
        ).alias("detail"),
        "flow_count",
    )
    return floods.unionByName(half_open).unionByName(sweeps)


def largest_sweep(sweeps: DataFrame) -> DataFrame:
    """The sweep with most distinct ports; ties by source and destination."""
    return sweeps.orderBy(F.desc("unique_ports"), "src", "dst").limit(1)


def attack_class(signatures: DataFrame, column: str = "signature_state") -> DataFrame:
    """Most severe signature state that fired, in the order DDoS, DoS, PortScan."""
    counts = signatures.agg(*[F.count_if(F.col(column) == c).alias(c) for c in ATTACK_CLASSES])
    return counts.select(F.coalesce(*[F.when(F.col(c) > 0, F.lit(c)) for c in ATTACK_CLASSES]).alias("attack_class"))


def capture_verdict(
    states: DataFrame, column: str = "current_state", signature_class: str | None = None,
    gates: Mapping[str, float] = MIN_ATTACK_RATIO, keys: Sequence[str] = (),
) -> DataFrame:
    """Headline of a capture: dominant state, attack share, and whether the attack's own share passes its gate.

    Shares are rounded to four places before they are compared. A signature of the same class confirms the attack.
    """
    counted = states.groupBy(*keys).agg(*[F.count_if(F.col(column) == c).alias(f"_{c}") for c in STATE_CLASSES])
    return verdict_from_counts(counted, {c: F.col(f"_{c}") for c in STATE_CLASSES}, signature_class, gates, keys)


def verdict_from_counts(
    counted: DataFrame, counts: Mapping[str, Column], signature_class: str | None = None,
    gates: Mapping[str, float] = MIN_ATTACK_RATIO, keys: Sequence[str] = (), scored: Column | None = None,
) -> DataFrame:
    scored = sum(counts.values(), F.lit(0)) if scored is None else scored
    attacks = scored - counts["BENIGN"]
    top = F.when(attacks > 0, argmax_label([counts[c] for c in ATTACK_CLASSES], ATTACK_CLASSES))
    own = F.coalesce(*[F.when(top == c, counts[c]) for c in ATTACK_CLASSES], F.lit(0))

    def share(part: Column) -> Column:
        return F.when(scored > 0, F.bround(part / scored, 4)).otherwise(F.lit(0.0))

    own_share = F.when(top.isNotNull(), share(own)).otherwise(F.lit(0.0))
    gate = F.coalesce(*[F.when(top == c, F.lit(float(gates[c]))) for c in ATTACK_CLASSES])
    confirmed = (own_share >= gate) | F.coalesce(F.lit(signature_class) == top, F.lit(False))
    return counted.select(
        *keys,
        argmax_label(list(counts.values()), STATE_CLASSES).alias("dominant_state"),
        scored.alias("scored_flow_count"),
        attacks.alias("attack_flow_count"),
        share(attacks).alias("malicious_flow_ratio"),
        own_share.alias("attack_class_ratio"),
        (attacks > 0).alias("attack_present"),
        top.alias("attack_class"),
        F.when(top.isNull(), F.lit("BENIGN"))
        .when(confirmed, F.concat(F.lit("ATTACK — "), top))
        .otherwise(F.concat(F.lit("SUSPICIOUS — "), top, F.lit("?")))
        .alias("verdict"),
        F.when(top.isNull(), F.lit("none")).when(confirmed, F.lit("high")).otherwise(F.lit("low")).alias("confidence"),
    )
