"""Quality gates and leakage audits. Every check is a one-row table with `status` and the counts behind it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from netstate.constants import SEQUENCE_LENGTH, STATE_CLASSES, STATE_FEATURES
from netstate.operators.profile import row_hash
from netstate.operators.splits import MinMaxModel, fit_min_max
from netstate.operators.transitions import chronological_position, order_audit, window_audit
from netstate.scale import WINDOW_BITS, stage, with_position, with_previous, with_running_total

SESSION = ("session_id",)
SPLITS = ("train", "validation", "test")
PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))

# Fixed limits of the checks.
ORDER_FAIL_ROWS = 5
ORDER_FAIL_SHARE = 0.05
NEGATIVE_TOLERANCE = 1.0
NON_NEGATIVE_HINTS = ("count", "packets", "bytes", "duration", "iat", "per_second", "size")


def _status(fail: Column, warn: Column) -> Column:
    return F.when(fail, F.lit("FAIL")).when(warn, F.lit("WARNING")).otherwise(F.lit("PASS")).alias("status")


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row tables in one row, without a join."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def label_check(flows: DataFrame, state: str = "current_state") -> DataFrame:
    """State labels: any label outside the four classes fails, the unscoreable marker included."""
    text = F.col(state).cast("string")
    missing = text.isNull() | (F.trim(text) == "")
    labelled = F.count(text)
    counts = [F.count_if(text == c).alias(f"{c.lower()}_count") for c in STATE_CLASSES]
    shares = [
        F.coalesce(F.round(100.0 * F.count_if(text == c) / F.nullif(labelled, F.lit(0)), 2), F.lit(0.0)).alias(
            f"{c.lower()}_percent"
        )
        for c in STATE_CLASSES
    ]
    unknown = F.count_if(text.isNotNull() & ~text.isin(STATE_CLASSES))
    row = flows.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(missing).alias("missing_labels"),
        unknown.alias("unknown_label_count"),
        labelled.alias("_labelled"),
        *counts,
        *shares,
    )
    fail = (F.col("missing_labels") == F.col("_labelled")) | (F.col("unknown_label_count") > 0)
    return row.withColumn("status", _status(fail, F.col("missing_labels") > 0)).drop("_labelled")


def unknown_labels(flows: DataFrame, state: str = "current_state") -> DataFrame:
    """Labels outside the four classes."""
    return flows.select(F.col(state).alias("label")).where(~F.col(state).isin(STATE_CLASSES)).distinct()


def timestamp_check(
    flows: DataFrame, timestamp: str = "timestamp", order: str = "flow_seq", keys: Sequence[str] = SESSION
) -> DataFrame:
    """Missing and repeated timestamps and rows out of source order.

    Disorder fails only when it touches more than five rows and more than 5 % of them; rows are re-sorted anyway.
    """
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    per_key = (
        flows.select(*keys, micros.alias("_us"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count("_us").alias("_valid"),
            F.count_distinct("_us").alias("_distinct"),
            F.min("_us").alias("_first"),
            F.max("_us").alias("_last"),
        )
    )
    joined = per_key.join(order_audit(flows, order, timestamp, keys), list(keys), "left")
    row = joined.agg(
        F.sum("_rows").alias("rows_checked"),
        F.sum("_valid").alias("valid_timestamps"),
        F.sum(F.col("_rows") - F.col("_valid")).alias("missing_or_invalid"),
        F.sum(F.col("_valid") - F.col("_distinct")).alias("duplicate_timestamps"),
        F.coalesce(F.sum("out_of_order_rows"), F.lit(0)).alias("out_of_order_rows"),
        ((F.max("_last") - F.min("_first")) / 1_000_000).alias("duration_seconds"),
    )
    valid, wrong = F.col("valid_timestamps"), F.col("out_of_order_rows")
    broken = (wrong > ORDER_FAIL_ROWS) & (wrong > valid * ORDER_FAIL_SHARE)
    return row.withColumn(
        "status", _status((F.coalesce(valid, F.lit(0)) == 0) | broken, (F.col("missing_or_invalid") > 0) | (wrong > 0))
    )


def duplicate_check(
    flows: DataFrame, columns: Sequence[str], timestamp: str = "timestamp", flow_id: str | None = None,
    keys: Sequence[str] = SESSION,
) -> DataFrame:
    """Exact duplicate rows (WARNING), duplicate timestamps and flow ids (informational)."""
    counts = []
    for name, chosen in (("exact_duplicate_rows", columns), ("duplicate_timestamps", [timestamp])) + (
        (("duplicate_flow_ids", [flow_id]),) if flow_id else ()
    ):
        rows = flows if name == "exact_duplicate_rows" else flows.where(F.col(chosen[0]).isNotNull())
        copies = rows.groupBy(*keys, *row_hash([F.col(c) for c in chosen])).agg((F.count(F.lit(1)) - 1).alias("_extra"))
        counts.append(copies.agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("value")).withColumn("metric", F.lit(name)))
    long = reduce(DataFrame.unionByName, counts)
    names = ["exact_duplicate_rows", "duplicate_timestamps"] + (["duplicate_flow_ids"] if flow_id else [])
    row = long.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    return row.withColumn("status", _status(F.lit(False), F.col("exact_duplicate_rows") > 0))


def missing_check(flows: DataFrame, timestamp: str = "timestamp", state: str = "current_state") -> DataFrame:
    """Missing timestamps and states, NaN or NULL and infinite numeric cells."""
    numeric = [f.name for f in flows.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")]
    floating = [f.name for f in flows.schema.fields if f.dataType.typeName() in ("double", "float")]

    def total(flags: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [flag.cast("long") for flag in flags], F.lit(0).cast("long"))

    empty = [F.col(c).isNull() | (F.isnan(c) if c in floating else F.lit(False)) for c in numeric]
    infinite = [F.coalesce(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(False)) for c in floating]
    row = flows.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(F.col(timestamp).isNull()).alias("missing_timestamps"),
        F.count_if(F.col(state).isNull()).alias("missing_current_state"),
        F.coalesce(F.sum(total(empty)), F.lit(0)).alias("nan_numeric_values"),
        F.coalesce(F.sum(total(infinite)), F.lit(0)).alias("infinite_values"),
    )
    flawed = (F.col("missing_timestamps") > 0) | (F.col("missing_current_state") > 0) | (F.col("infinite_values") > 0)
    return row.withColumn("status", _status(F.col("rows_checked") == 0, flawed))


def window_check(states: DataFrame, window_seconds: int, keys: Sequence[str] = SESSION) -> DataFrame:
    """Window lengths, repeated ids and overlaps fail; gaps in traffic warn."""
    names = [
        "total_windows", "bad_duration_windows", "missing_windows", "duplicate_window_ids", "overlapping_windows",
    ]
    row = window_audit(states, window_seconds, keys).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    broken = F.col("bad_duration_windows") + F.col("duplicate_window_ids") + F.col("overlapping_windows") > 0
    return row.withColumn("status", _status((F.col("total_windows") == 0) | broken, F.col("missing_windows") > 0))


def feature_health(states: DataFrame, features: Sequence[str] = STATE_FEATURES) -> DataFrame:
    """One row per window feature: NaN and infinite cells, range, constancy and status."""
    structs = []
    for name in features:
        if name not in states.columns:
            structs.append(
                F.struct(
                    F.lit(name).alias("feature"), F.lit(0).cast("long").alias("nan"),
                    F.lit(0).cast("long").alias("infinite"), F.lit(None).cast("double").alias("min"),
                    F.lit(None).cast("double").alias("max"), F.lit(False).alias("constant"),
                    F.lit("FAIL").alias("status"),
                )
            )
            continue
        raw = F.col(name).cast("double")
        value = F.when(~F.isnan(raw), raw)
        nan = F.count_if(raw.isNull() | F.isnan(raw))
        infinite = F.count_if(F.coalesce(F.abs(raw) == F.lit(float("inf")), F.lit(False)))
        low, high = F.min(value), F.max(value)
        guarded = any(hint in name for hint in NON_NEGATIVE_HINTS)
        below = F.coalesce(low < -NEGATIVE_TOLERANCE, F.lit(False)) & F.lit(guarded)
        slightly = F.coalesce(low < 0, F.lit(False)) & F.lit(guarded)
        structs.append(
            F.struct(
                F.lit(name).alias("feature"),
                nan.alias("nan"),
                infinite.alias("infinite"),
                low.alias("min"),
                high.alias("max"),
                F.coalesce(low == high, F.lit(True)).alias("constant"),
                _status(below, slightly | (nan > 0) | (infinite > 0)),
            )
        )
    return states.agg(F.array(*structs).alias("_f")).select(F.inline("_f"))


def feature_check(states: DataFrame, features: Sequence[str] = STATE_FEATURES) -> DataFrame:
    health = feature_health(states, features)
    return health.agg(
        F.count(F.lit(1)).alias("features_checked"),
        F.sum("nan").alias("nan_values"),
        F.sum("infinite").alias("infinite_values"),
        F.count_if(F.col("status") == "FAIL").alias("range_violations"),
        F.max_by("status", F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARNING", 1).otherwise(0)).alias(
            "status"
        ),
    )


def transition_check(states: DataFrame, changes: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Dangling window references, invalid labels, backward time and states that contradict the window table."""
    keys = list(keys)
    known = states.select(*keys, F.col("window_id"), F.col("dominant_state").alias("_state"))
    current = known.select(*keys, F.col("window_id").alias("current_window"), F.lit(True).alias("_current"))
    following = known.select(*keys, F.col("window_id").alias("next_window"), F.col("_state").alias("_next_state"))
    joined = changes.join(current, [*keys, "current_window"], "left").join(following, [*keys, "next_window"], "left")
    names = ["current_state", "next_state"]
    valid = reduce(lambda a, b: a & b, [F.coalesce(F.col(n).isin(STATE_CLASSES), F.lit(False)) for n in names])
    row = joined.agg(
        F.count(F.lit(1)).alias("total_transitions"),
        F.count_if(F.col("_current").isNull()).alias("invalid_current_window_refs"),
        F.count_if(F.col("_next_state").isNull()).alias("invalid_next_window_refs"),
        F.count_if(~valid).alias("invalid_state_labels"),
        F.count_if(F.col("time_delta_seconds") < 0).alias("backward_time_transitions"),
        F.count_if(~F.col("next_state").eqNullSafe(F.col("_next_state"))).alias("consistency_mismatches"),
    )
    faults = reduce(lambda a, b: a + b, [F.col(c) for c in row.columns[1:]])
    return row.withColumn("status", _status(faults > 0, F.col("total_transitions") == 0))


def sequence_check(
    states: DataFrame, sequences: DataFrame, length: int = SEQUENCE_LENGTH, keys: Sequence[str] = SESSION,
    bits: int = WINDOW_BITS,
) -> DataFrame:
    """Length, target alignment by position, expected count N - length, and repeated contents."""
    keys = list(keys)
    positions = with_position(states.select(*keys, "window_id"), keys, "window_id", bits, "_position")
    last = positions.select(*keys, F.col("window_id").alias("_last"), F.col("_position").alias("_last_position"))
    target = positions.select(*keys, F.col("window_id").alias("target_window_id"), F.col("_position").alias("_target"))
    rows = sequences.select(
        *keys,
        "target_window_id",
        F.element_at("input_window_ids", -1).alias("_last"),
        F.size("input_window_ids").alias("_size"),
        *row_hash([F.col("X")]),
    )
    joined = rows.join(last, [*keys, "_last"], "left").join(target, [*keys, "target_window_id"], "left")
    aligned = F.coalesce(F.col("_target") == F.col("_last_position") + 1, F.lit(False))
    measured = joined.groupBy("_h1", "_h2").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~aligned).alias("_misaligned"),
        F.count_if(F.col("_size") != length).alias("_wrong_length"),
    )
    sums = measured.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_sequences"),
        F.coalesce(F.sum("_misaligned"), F.lit(0)).alias("target_misaligned"),
        F.coalesce(F.sum("_wrong_length"), F.lit(0)).alias("wrong_length"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_sequences"),
    )
    expected = (
        states.groupBy(*keys)
        .agg(F.greatest(F.count(F.lit(1)) - length, F.lit(0)).alias("_e"))
        .agg(F.coalesce(F.sum("_e"), F.lit(0)).alias("expected_sequences"))
    )
    row = one_row(sums, expected)
    fail = (F.col("wrong_length") > 0) | (F.col("target_misaligned") > 0)
    warn = (F.col("total_sequences") != F.col("expected_sequences")) | (F.col("duplicate_sequences") > 0)
    return row.withColumn("status", _status(fail, warn))


def split_order_check(sequences: DataFrame, keys: Sequence[str] = SESSION, split: str = "split") -> DataFrame:
    """Targets of each split must end before those of the next split begin, session by session."""
    bounds = []
    for name in SPLITS:
        here = F.when(F.col(split) == name, F.col("target_window_id"))
        bounds += [F.min(here).alias(f"_{name}_low"), F.max(here).alias(f"_{name}_high")]
        bounds.append(F.count_if(F.col(split) == name).alias(name))
    per_key = sequences.groupBy(*keys).agg(*bounds)

    def disordered(first: str, second: str) -> Column:
        return F.coalesce(F.col(f"_{first}_high") >= F.col(f"_{second}_low"), F.lit(False))

    wrong = reduce(lambda a, b: a | b, [disordered(a, b) for a, b in PAIRS])
    row = per_key.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(f"{name}_sequences") for name in SPLITS],
        F.count_if(wrong).alias("disordered_sessions"),
    )
    return row.withColumn("status", _status(F.col("disordered_sessions") > 0, F.lit(False)))


def leakage_check(sequences: DataFrame, keys: Sequence[str] = SESSION, split: str = "split") -> DataFrame:
    """Sequences of equal content in two splits, and sequences that share an input window with another split.

    Contents and windows are each grouped once and carry one flag per split; nothing is compared pairwise.
    """
    keys = list(keys)
    flags = [F.bool_or(F.col(split) == name).alias(f"_{name}") for name in SPLITS]
    narrow = stage(sequences.select(*keys, split, "target_window_id", "input_window_ids", *row_hash([F.col("X")])))
    contents = narrow.groupBy("_h1", "_h2").agg(*flags)
    duplicates = contents.agg(
        *[F.count_if(F.col(f"_{a}") & F.col(f"_{b}")).alias(f"duplicate_{a}_{b}") for a, b in PAIRS]
    )
    # A window stands in as many sequences of a split as a sequence is long, so its list is short.
    used = narrow.select(*keys, split, "target_window_id", F.explode("input_window_ids").alias("_window"))
    owners = used.groupBy(*keys, "_window").agg(*flags, F.collect_list(F.struct(split, "target_window_id")).alias("_users"))
    touched = owners.select(*keys, *[f"_{name}" for name in SPLITS], F.inline("_users")).groupBy(*keys, split, "target_window_id").agg(
        *[F.bool_or(f"_{name}").alias(f"_{name}") for name in SPLITS]
    )
    overlaps = touched.agg(
        *[F.count_if((F.col(split) == a) & F.col(f"_{b}")).alias(f"overlap_{a}_{b}") for a, b in PAIRS]
    )
    row = one_row(duplicates, overlaps)
    faults = reduce(lambda a, b: a + b, [F.col(c) for c in row.columns])
    return row.withColumn("status", _status(faults > 0, F.lit(False)))


def label_leakage(features: Sequence[str] = STATE_FEATURES) -> list[str]:
    """Features named like a target."""
    targets = {"dominant_state", "attack_present", *[f"{c.lower()}_flow_count" for c in STATE_CLASSES]}
    return sorted(targets.intersection(name.lower() for name in features))


def _outside_of_stretches(sequences: DataFrame, windows: DataFrame, keys: Sequence[str], split: str) -> Row:
    """How many sequences leave a stretch of their session's consecutive windows (foreign), or one without a pause (broken)."""
    within = [*keys, split]
    own = windows.select(*within, "window_id", F.unix_micros("window_start").alias("_start"), F.unix_micros("window_end").alias("_end"))
    linked = with_previous(own, within, "window_id", ["window_id", "_end"], "_prev_")
    apart = F.coalesce(F.col("window_id") - F.col("_prev_window_id") != 1, F.lit(True))
    linked = linked.select(
        *within, "window_id", apart.cast("long").alias("_apart"), (apart | F.coalesce(F.col("_start") != F.col("_prev__end"), F.lit(True))).cast("long").alias("_pause")
    )
    stretches = with_running_total(with_running_total(linked, within, "window_id", "_apart", "_stretch"), within, "window_id", "_pause", "_chain")
    stretches = stage(stretches.select(*within, "window_id", "_stretch", "_chain"))
    found = sequences.select(*within, F.col("input_window_ids")[0].alias("_first"), "target_window_id")
    for end, window in (("a", "_first"), ("b", "target_window_id")):
        side = stretches.select(*[F.col(c).alias(f"_{end}{i}") for i, c in enumerate(within)], F.col("window_id").alias(f"_{end}w"), F.struct("_stretch", "_chain").alias(end))
        same = [F.col(c).eqNullSafe(F.col(f"_{end}{i}")) for i, c in enumerate(within)]
        found = found.join(side, [*same, F.col(window) == F.col(f"_{end}w")], "left").select(*found.columns, end)

    def differ(name: str) -> Column:
        return F.coalesce(F.col(f"a.{name}") != F.col(f"b.{name}"), F.lit(True))

    return found.agg(F.count_if(differ("_stretch")).alias("foreign"), F.count_if(differ("_chain")).alias("broken")).first()


def training_audit(
    sequences: DataFrame, scaler: MinMaxModel, windows: DataFrame, features: Sequence[str] = STATE_FEATURES,
    keys: Sequence[str] = SESSION, split: str = "split",
) -> DataFrame:
    """Nine leakage checks of a training run, one row each, plus `overall`; every one is counted.

    windows are those of all splits. A sequence from its first input to its target must lie in one stretch of consecutive
    windows of its own session and split (session boundary), whose times follow each other without a pause (continuity); no
    input may stand at or behind the target (future features). The others cover target provenance and content shared by
    splits, alignment of inputs and target, labels, and whether the scaler equals one refitted on the training windows.
    """
    keys = list(keys)
    sequences = stage(
        sequences.select(*keys, split, "target_window_id", "input_window_ids", "input_labels", "y_dominant_state", *row_hash([F.col("X"), F.col("input_labels")]))
    )
    flags = [F.bool_or(F.col(split) == name).alias(f"_{name}") for name in SPLITS]
    targets = sequences.groupBy(*keys, "target_window_id").agg(*flags)
    contents = sequences.groupBy("_h1", "_h2").agg(*flags)

    def shared(a: str, b: str) -> Column:
        return F.count_if(F.col(f"_{a}") & F.col(f"_{b}"))

    ids = F.col("input_window_ids")
    first, last = ids[0], F.element_at(ids, -1)
    consecutive = (last - first == F.size(ids) - 1) & (F.size(F.array_distinct(ids)) == F.size(ids))
    aligned = consecutive & (F.col("target_window_id") == last + 1)
    known = F.array(*[F.lit(c) for c in STATE_CLASSES])
    labelled = F.col("y_dominant_state").isin(STATE_CLASSES) & (
        F.size(F.array_except(F.col("input_labels"), known)) == 0
    )
    overlap = targets.agg(shared("train", "validation").alias("tv"), shared("train", "test").alias("tt")).first()
    copies = contents.agg(*[shared(a, b).alias(f"{a}_{b}") for a, b in PAIRS]).first()
    future = F.exists("input_window_ids", lambda w: w >= F.col("target_window_id"))
    shape = sequences.agg(
        F.count_if(~aligned).alias("misaligned"), F.count_if(~labelled).alias("unlabelled"), F.count_if(future).alias("future")
    ).first()
    outside = _outside_of_stretches(sequences, windows, keys, split)
    refit = fit_min_max(windows.where(F.col(split) == "train"), features)
    close = all(
        abs(scaler.minimum[f] - refit.minimum[f]) <= 1e-12 and abs(scaler.maximum[f] - refit.maximum[f]) <= 1e-12
        for f in features
    )
    checks: Mapping[str, int] = {
        "session_boundary_leakage": outside["foreign"],
        "train_validation_overlap": overlap["tv"],
        "train_test_overlap": overlap["tt"],
        "scaler_train_only": 0 if close and scaler.rows == refit.rows else 1,
        "next_window_alignment": shape["misaligned"],
        "future_feature_leakage": shape["future"],
        "duplicate_sequence_leakage": sum(copies),
        "invalid_features_exclusion": shape["unlabelled"],
        "synthetic_session_continuity": outside["broken"],
    }
    rows = [(name, "FAIL" if count else "PASS", int(count), "counted") for name, count in checks.items()]
    total = sum(1 for row in rows if row[1] == "FAIL")
    rows.append(("overall", "FAIL" if total else "PASS", total, "counted"))
    return sequences.sparkSession.createDataFrame(rows, "check string, status string, violations long, basis string")


def build_gates(
    flows: DataFrame, windowed: DataFrame, states: DataFrame, timestamp: str = "timestamp",
    features: Sequence[str] = STATE_FEATURES, keys: Sequence[str] = SESSION, order: str = "flow_seq",
) -> DataFrame:
    """The seven build-time gates, one row each: a dataset is only built when all pass."""
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    start, end = F.unix_micros("window_start"), F.unix_micros("window_end")
    valid = flows.agg(F.count(timestamp).alias("n")).first()["n"] if timestamp in flows.columns else 0
    placed = chronological_position(flows.where(F.col(timestamp).isNotNull()), timestamp, order, keys)
    descents = order_audit(placed, "place", timestamp, keys).agg(F.coalesce(F.sum("out_of_order_rows"), F.lit(0)).alias("n")).first()["n"]
    outside = windowed.agg(F.count_if((micros < start) | (micros >= end)).alias("n")).first()["n"]
    audit = window_audit(states, 0, keys).agg(F.coalesce(F.sum("overlapping_windows"), F.lit(0)).alias("n")).first()["n"]
    numeric = {"double", "float", "integer", "long", "short", "byte"}
    wrong = [f for f in features if f not in states.columns or states.schema[f].dataType.typeName() not in numeric]
    labels = states.where(~F.col("dominant_state").isin(STATE_CLASSES)).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    rows = [
        ("timestamp_column_exists", timestamp in flows.columns, 0),
        ("timestamps_parseable", valid > 0, valid),
        ("chronological_order", descents == 0, descents),
        ("window_assignment", outside == 0, outside),
        ("no_future_leakage", audit == 0, audit),
        ("state_features_numeric", not wrong, len(wrong)),
        ("state_labels_valid", labels == 0, labels),
    ]
    return states.sparkSession.createDataFrame(rows, "gate string, passed boolean, rows long")


def class_support_gate(sequences: DataFrame, split: str = "split", label: str = "y_dominant") -> DataFrame:
    """Every class needs training targets, and the distributed flood class needs validation targets."""
    rows = sequences.select(split, F.explode(label).alias("_label"))
    counts = rows.agg(
        *[F.count_if((F.col(split) == "train") & (F.col("_label") == c)).alias(f"train_{c.lower()}") for c in STATE_CLASSES],
        F.count_if((F.col(split) == "validation") & (F.col("_label") == "DDoS")).alias("validation_ddos"),
    )
    absent = reduce(lambda a, b: a | b, [F.col(c) == 0 for c in counts.columns])
    return counts.withColumn("status", _status(absent, F.lit(False)))


def probability_sanity(predictions: DataFrame, probabilities: Sequence[str]) -> DataFrame:
    """Finite probabilities that sum to 1, and at least two predicted classes."""
    total = reduce(lambda a, b: a + b, [F.col(p) for p in probabilities])
    bad = reduce(
        lambda a, b: a | b,
        [F.col(p).isNull() | F.isnan(p) | (F.abs(F.col(p)) == F.lit(float("inf"))) for p in probabilities],
    )
    return predictions.agg(
        (F.count_if(bad) == 0).alias("finite_probabilities"),
        (F.count_if(F.abs(total - 1.0) > 1e-5) == 0).alias("probability_sums"),
        (F.count_distinct("y_pred") >= 2).alias("prediction_diversity"),
    )


def promotion_gates(
    summary: DataFrame, classes: DataFrame, attacks: DataFrame, candidate: str, baseline: str, model: str = "model"
) -> DataFrame:
    """Whether a candidate replaces its baseline: macro F1 and flood recall better, false positives within one point."""
    def value(column: str, name: str) -> Column:
        return F.max(F.when(F.col(model) == name, F.col(column)))

    f1 = summary.agg((value("macro_f1", candidate) > value("macro_f1", baseline)).alias("macro_f1_improves"))
    flood = classes.where(F.col("class") == "DDoS")
    recall = flood.agg(
        (value("support", candidate) > 0).alias("ddos_support"),
        (value("recall", candidate) > value("recall", baseline)).alias("ddos_recall_improves"),
    )
    fpr = "false_positive_rate"
    alarms = attacks.agg((value(fpr, candidate) <= value(fpr, baseline) + 0.01).alias("benign_fpr_within_one_point"))
    long = [
        part.unpivot([], part.columns, "gate", "passed").withColumn("passed", F.coalesce("passed", F.lit(False)))
        for part in (f1, recall, alarms)
    ]
    return reduce(DataFrame.unionByName, long)


def activation_gates(promotion: DataFrame, training: DataFrame, threshold: DataFrame, label: str = "y_true") -> DataFrame:
    """The promotion gates, whether training held the flood class, whether a warning threshold was found, and `active`: all of them."""
    support = training.agg((F.count_if(F.col(label) == "DDoS") > 0).alias("passed"))
    chosen = threshold.select(F.col("selected_threshold").isNotNull().alias("passed"))
    named = [(support, "ddos_training_support"), (chosen, "warning_threshold_selected")]
    listed = reduce(DataFrame.unionByName, [promotion, *[f.select(F.lit(n).alias("gate"), "passed") for f, n in named]])
    return listed.unionByName(listed.agg(F.lit("active").alias("gate"), F.bool_and("passed").alias("passed")))


def label_leakage_check(features: Sequence[str], flows: DataFrame) -> DataFrame:
    """Features that are named like a target fail; one row, as the other checks of a dataset."""
    leaked = label_leakage(features)
    row = flows.agg(F.lit(len(leaked)).cast("long").alias("leaked_features"), F.lit(",".join(leaked)).alias("names"))
    return row.withColumn("status", _status(F.col("leaked_features") > 0, F.lit(False)))


def combine_checks(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check with its status and its counts as JSON, plus `overall`: the worst status."""
    rows = [
        check.select(
            F.lit(name).alias("check"),
            "status",
            F.to_json(F.struct(*[c for c in check.columns if c != "status"])).alias("details"),
        )
        for name, check in checks.items()
    ]
    listed = reduce(DataFrame.unionByName, rows)
    severity = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARNING", 1).otherwise(0)
    worst = listed.agg(F.max(severity).alias("_s")).select(
        F.lit("overall").alias("check"),
        F.when(F.col("_s") == 2, F.lit("FAIL")).when(F.col("_s") == 1, F.lit("WARNING")).otherwise(F.lit("PASS")).alias(
            "status"
        ),
        F.lit("{}").alias("details"),
    )
    return listed.unionByName(worst)
