from datetime import timedelta

from pyspark.sql import functions as F
from tests.helpers import START, flow, flows, windows

from netstate.operators import audits, profile, splits
from netstate.operators import sequences as seq
from netstate.operators.transitions import transitions
from netstate.plans.dataset import insufficient_data, load_dataset, prepare_dataset, validate_dataset


def test_labels(spark):
    clean = flows(spark, [flow(i) for i in range(4)])
    assert audits.label_check(clean).first()["status"] == "PASS"
    assert audits.label_check(clean.withColumn("current_state", F.when(F.col("flow_seq") > 0, F.col("current_state")))).first()["status"] == "WARNING"
    row = audits.label_check(clean.withColumn("current_state", F.lit("INVALID_FEATURES"))).first()
    assert row["status"] == "FAIL" and row["unknown_label_count"] == 4


def test_order(spark):
    rows = [flow(i) for i in range(100)]
    assert audits.timestamp_check(flows(spark, rows)).first()["status"] == "PASS"
    swapped = [dict(r) for r in rows]
    swapped[10]["timestamp"], swapped[11]["timestamp"] = swapped[11]["timestamp"], swapped[10]["timestamp"]
    row = audits.timestamp_check(flows(spark, swapped)).first()
    assert (row["status"], row["out_of_order_rows"]) == ("WARNING", 1)
    backwards = [dict(r, timestamp=START - timedelta(seconds=r["flow_seq"])) for r in rows]
    assert audits.timestamp_check(flows(spark, backwards)).first()["status"] == "FAIL"
    empty = [dict(r, timestamp=None) for r in rows]
    assert audits.timestamp_check(flows(spark, empty)).first()["status"] == "FAIL"


def test_feature_health(spark):
    table = windows(spark, range(5))
    jitter = table.withColumn("min_iat", F.lit(-1e-4))
    broken = table.withColumn("min_iat", F.lit(-2.0))
    nan = table.withColumn("total_bytes", F.lit(float("nan")))
    status = lambda t, f: {r["feature"]: r["status"] for r in audits.feature_health(t).collect()}[f]
    assert status(table, "min_iat") == "PASS"
    assert status(jitter, "min_iat") == "WARNING" and audits.feature_check(jitter).first()["status"] == "WARNING"
    assert status(broken, "min_iat") == "FAIL" and audits.feature_check(broken).first()["status"] == "FAIL"
    assert status(nan, "total_bytes") == "WARNING"
    assert {r["feature"] for r in audits.feature_health(jitter).where("constant").collect()} == {"min_iat"}


def test_transitions_and_sequences(spark):
    table = windows(spark, range(20))
    moves = transitions(table)
    assert audits.transition_check(table, moves).first()["status"] == "PASS"
    assert audits.transition_check(table, moves.withColumn("next_state", F.lit("DoS"))).first()["consistency_mismatches"] == 19
    sequences = seq.sequences_positional(table)
    row = audits.sequence_check(table, sequences).first()
    assert (row["status"], row["total_sequences"], row["expected_sequences"]) == ("PASS", 15, 15)
    shifted = sequences.withColumn("target_window_id", F.col("target_window_id") + 1)
    assert audits.sequence_check(table, shifted).first()["status"] == "FAIL"


def test_leakage_is_found(spark):
    table = windows(spark, range(60))
    clean = seq.sequences_positional(splits.chronological_split(table), within=["split"])
    assert audits.leakage_check(clean).first()["status"] == "PASS"
    assert audits.split_order_check(clean).first()["status"] == "PASS"
    mixed = seq.sequences_positional(table).withColumn("split", F.when(F.col("target_window_id") % 2 == 0, "train").otherwise("test"))
    row = audits.leakage_check(mixed).first()
    assert row["status"] == "FAIL" and row["overlap_train_test"] > 0
    copied = clean.unionByName(clean.where("split = 'train'").limit(1).withColumn("split", F.lit("test")))
    assert audits.leakage_check(copied).first()["duplicate_train_test"] == 1
    assert audits.label_leakage() == []


def failed(audit):
    return {r["check"] for r in audit.where("status = 'FAIL'").collect()} - {"overall"}


def test_training_audit(spark):
    parts = splits.final_split(windows(spark, range(80)))
    train = splits.fit_min_max(parts.where("split = 'train'"))
    sequences = seq.sequences_gap_aware(parts, within=["split"])
    good = audits.training_audit(sequences, train, parts)
    assert good.where("status = 'FAIL'").isEmpty() and good.count() == 10 and good.where("basis = 'counted'").count() == 10
    assert failed(audits.training_audit(sequences, splits.fit_min_max(parts), parts)) == {"scaler_train_only"}


def test_training_audit_finds_each_planted_leak(spark):
    """One change per check; some changes are two leaks at once."""
    parts = splits.final_split(windows(spark, range(80))).cache()
    train = splits.fit_min_max(parts.where("split = 'train'"))
    sequences = seq.sequences_gap_aware(parts, within=["split"]).cache()

    def found(changed=None, own=None):
        return failed(audits.training_audit(sequences if changed is None else changed, train, parts if own is None else own))

    one = sequences.where("split = 'train'").orderBy("target_window_id").limit(1)
    foreign = sequences.withColumn("session_id", F.when(F.col("target_window_id") == 30, "other").otherwise(F.col("session_id")))
    assert found(foreign) == {"session_boundary_leakage", "synthetic_session_continuity"}
    copy = one.withColumn("input_labels", F.array(*[F.lit("DDoS")] * 5))
    assert "train_validation_overlap" in found(sequences.unionByName(copy.withColumn("split", F.lit("validation"))))
    assert "train_test_overlap" in found(sequences.unionByName(copy.withColumn("split", F.lit("test"))))
    shifted = sequences.withColumn("target_window_id", F.col("target_window_id") + (F.col("target_window_id") == 20).cast("int"))
    assert found(shifted) == {"next_window_alignment"}
    ahead = sequences.withColumn(
        "input_window_ids", F.when(F.col("target_window_id") == 20, F.transform("input_window_ids", lambda w: w + 1)).otherwise(F.col("input_window_ids"))
    )
    assert found(ahead) == {"next_window_alignment", "future_feature_leakage"}
    again = one.withColumn("split", F.lit("test")).withColumn("target_window_id", F.lit(1000).cast("long"))
    assert "duplicate_sequence_leakage" in found(sequences.unionByName(again))
    unknown = sequences.withColumn("y_dominant_state", F.when(F.col("target_window_id") == 20, "INVALID_FEATURES").otherwise(F.col("y_dominant_state")))
    assert found(unknown) == {"invalid_features_exclusion"}
    late = F.when(F.col("window_id") >= 25, F.expr("interval 1 hour")).otherwise(F.expr("interval 0 hour"))
    paused = parts.withColumns({c: F.col(c) + late for c in ("window_start", "window_end")})
    assert found(own=paused) == {"synthetic_session_continuity"}
    assert found(own=parts.where("window_id <> 25")) >= {"session_boundary_leakage", "synthetic_session_continuity"}


def test_profile_counts_invalid_constant_and_duplicate(spark):
    table = spark.createDataFrame(
        [("s", 1, "1", "Infinity", "x"), ("s", 2, "2", "3", "x"), ("s", 3, "2", "3", "x"), ("s", 4, None, "4", "x")],
        "session_id string, flow_seq long, a string, b string, c string",
    )
    row = profile.source_profile(table).first()
    assert (row["rows"], row["columns"], row["invalid_values"], row["duplicate_rows"]) == (4, 3, 2, 1)
    stats = {r["column"]: r for r in profile.column_statistics(table, ["a", "b", "c"]).collect()}
    assert stats["c"]["is_constant"] and not stats["a"]["is_constant"]
    assert (stats["b"]["numeric_min"], stats["b"]["numeric_max"], stats["b"]["non_null_values"]) == (3.0, 4.0, 4)


def test_dataset_end_to_end(spark, tmp_path):
    states = ["BENIGN", "DDoS", "DoS", "PortScan"]
    rows = [flow(i, timestamp=START + timedelta(seconds=5 * i), current_state=states[i // 8 % 4]) for i in range(240)]
    table = flows(spark, rows).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    summary = prepare_dataset(table, str(tmp_path / "data")).first()
    assert (summary["total_windows"], summary["total_sequences"], summary["transitions"]) == (120, 115, 119)
    assert summary["ddos_flows"] == 64
    stored = load_dataset(spark, str(tmp_path / "data"))
    checks = validate_dataset(
        flows(spark, rows), stored["states"], stored["transitions"], stored["sequences"], stored["split_sequences"]
    )
    got = {r["check"]: r["status"] for r in checks.collect()}
    assert len(got) == 12 and got["overall"] in ("PASS", "WARNING") and got["leakage"] == got["label_leakage"] == "PASS"


def test_short_capture_is_refused(spark, tmp_path):
    import pytest

    table = flows(spark, [flow(i) for i in range(10)])
    with pytest.raises(ValueError, match="available windows 2"):
        prepare_dataset(table, str(tmp_path / "short"))
    from netstate.operators.states import window_states

    row = insufficient_data(table, window_states(table)).first()
    assert (row["required_windows"], row["flow_records"]) == (6, 10)
