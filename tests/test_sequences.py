import pytest
from tests.helpers import windows
from pyspark.sql import functions as F

from netstate.constants import STATE_FEATURES
from netstate.operators import sequences as seq
from netstate.operators import splits


def test_positional_sequences_number_and_alignment(spark):
    out = seq.sequences_positional(windows(spark, [0, 1, 2, 4, 5, 6, 9, 10]), bits=4).orderBy("target_window_id").collect()
    assert [r["target_window_id"] for r in out] == [6, 9, 10]
    assert out[0]["input_window_ids"] == [0, 1, 2, 4, 5]
    assert out[0]["X"][0] == [float(j) for j in range(28)] and out[0]["y_state_vector"][0] == 6.0


def test_gap_aware_sequences_do_not_bridge(spark):
    out = seq.sequences_gap_aware(windows(spark, [*range(6), *range(8, 14)]), bits=4)
    assert sorted(r["target_window_id"] for r in out.collect()) == [5, 13]
    assert out.count() == 2


@pytest.mark.parametrize("bits", [4, 5, 16])
def test_chunks_do_not_change_sequences(spark, bits):
    out = seq.multistep_sequences(windows(spark, [*range(40), *range(50, 70)]), bits=bits)
    samples = {r["sample_id"] for r in out.select("sample_id").collect()}
    assert len(samples) == (40 - 10) + (20 - 10)
    assert "s:0:10" in samples and "s:59:69" in samples


def test_multistep_needs_known_states(spark):
    states = ["BENIGN"] * 12
    states[3] = "INVALID_FEATURES"
    assert {r["sample_id"] for r in seq.multistep_sequences(windows(spark, range(12), states=states)).select("sample_id").collect()} == set()
    row = seq.multistep_sequences(windows(spark, range(11))).first()
    assert len(row["X"]) == 5 and len(row["y_dominant"]) == 6 and len(row["X"][0]) == 28


def test_split_covers_windows_in_order(spark):
    parts = splits.chronological_split(windows(spark, range(25)), bits=3)
    bounds = {r["split"]: (r["n_windows"], r["first_window"], r["last_window"]) for r in splits.split_bounds(parts).collect()}
    assert bounds == {"train": (18, 0, 17), "validation": (4, 18, 21), "test": (3, 22, 24)}  # 17.5 and 3.75 round half to even
    inside = seq.sequences_positional(parts, within=["split"], bits=4)
    assert {r["split"] for r in inside.select("split").distinct().collect()} == {"train"}


def test_holdout_and_folds(spark):
    table = windows(spark, range(40))
    halves = splits.holdout_split(table).groupBy("split").agg(F.min("window_id").alias("a"), F.max("window_id").alias("b")).collect()
    assert {r["split"]: (r["a"], r["b"]) for r in halves} == {"train": (0, 33), "holdout": (39, 39)}
    folds = splits.rolling_folds(windows(spark, range(100))).groupBy("fold", "role").agg(
        F.min("window_id").alias("a"), F.max("window_id").alias("b")).collect()
    assert {(r["fold"], r["role"]): (r["a"], r["b"]) for r in folds}[(1, "validation")] == (45, 59)
    assert splits.rolling_folds(windows(spark, range(23))).isEmpty()


def test_embargo_partition(spark):
    table = windows(spark, range(120), session="ddos").unionByName(windows(spark, range(5), session="mon"))
    out = splits.embargo_split(table, {"mon.csv": "train"}, "ddos")
    ranges = out.where("session_id = 'ddos'").groupBy("split").agg(F.min("window_id").alias("a"), F.max("window_id").alias("b")).collect()
    assert {r["split"]: (r["a"], r["b"]) for r in ranges} == {"train": (0, 71), "validation": (78, 95), "test": (102, 119)}
    splits.require_partition_length(out, "ddos")
    with pytest.raises(RuntimeError):
        splits.require_partition_length(out, "mon")


def test_scaler_sees_train_only(spark, tmp_path):
    table = windows(spark, range(10)).withColumn("urg_count", F.lit(3.0))
    model = splits.fit_min_max(table.where("window_id < 5"))
    row = model.transform(table.where("window_id = 9")).first()
    assert row["flow_count"] == pytest.approx(9 / 4) and row["urg_count"] == 0.0
    model.save(spark, str(tmp_path / "scaler"))
    assert splits.MinMaxModel.load(spark, str(tmp_path / "scaler")) == model
    vectors = table.select(model.transform_vectors(F.array(F.array(*[F.col(f) for f in STATE_FEATURES])), STATE_FEATURES).alias("v"))
    assert vectors.first()["v"][0][0] == 0.0


def test_recent_windows_must_be_contiguous(spark):
    table = windows(spark, range(8), session="a").unionByName(windows(spark, [0, 1, 2, 4, 5], session="b")).unionByName(
        windows(spark, range(3), session="c"))
    out = seq.recent_windows(table).orderBy("window_id").collect()
    assert [(r["session_id"], r["window_id"]) for r in out] == [("a", w) for w in range(3, 8)]
    assert {r["session_id"] for r in seq.require_windows(table).collect()} == {"b", "c"}


def test_capped_and_split_rows_per_class(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("c"))
    kept = splits.first_per_class(rows, 7, "c", "id", bits=3)
    assert sorted(r["id"] for r in kept.where("c = 'x'").collect()) == [0, 10, 20, 30, 40, 50, 60]
    counts = {(r["c"], r["split"]): r["count"] for r in splits.split_within_class(rows, "c", "id", bits=3).groupBy("c", "split").count().collect()}
    assert counts == {("x", "train"): 8, ("x", "validation"): 2, ("y", "train"): 72, ("y", "validation"): 18}
