import math

import pytest
from tests.helpers import predictions
from pyspark.sql import functions as F

from netstate.operators import horizons as hz
from netstate.operators import metrics as mt


def rows(pairs):
    order = ["BENIGN", "DDoS", "DoS", "PortScan"]
    out = []
    for t, p in pairs:
        probs = [0.7 if c == p else 0.1 for c in order]
        out.append((t, p, *probs, "BENIGN"))
    return out


def test_attack_ratios(spark):
    table = predictions(spark, rows([("BENIGN", "BENIGN")] * 3 + [("BENIGN", "DoS"), ("DoS", "DoS"), ("DDoS", "BENIGN")]))
    row = mt.attack_metrics(table).first()
    assert row["false_positive_rate"] == 0.25 and row["recall"] == 0.5 and (row["tp"], row["fn"]) == (1, 1)
    quiet = mt.attack_metrics(predictions(spark, rows([("BENIGN", "BENIGN")]))).first()
    assert quiet["recall"] is None and quiet["f1"] is None and quiet["false_positive_rate"] == 0.0


def test_absent_classes(spark):
    table = predictions(spark, rows([("BENIGN", "BENIGN")] * 2 + [("DDoS", "DDoS")] * 2 + [("DDoS", "BENIGN")] + [("DoS", "DoS")]))
    row = mt.summary_metrics(table).first()
    assert row["balanced_accuracy"] == pytest.approx((1 + 2 / 3 + 1) / 3)
    assert row["macro_recall"] == pytest.approx((1 + 2 / 3 + 1) / 4)
    assert row["evaluation_status"] == "limited_attack_support"
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in mt.confusion(table).collect()}
    assert len(cells) == 16 and cells[("DDoS", "BENIGN")] == 1 and cells[("PortScan", "DoS")] == 0


def test_ranking_against_pair_counting(spark):
    scores = [(i % 3 == 0, (i * 37 % 11) / 11) for i in range(60)]
    table = predictions(spark, [("BENIGN" if hit else "DoS", "BENIGN", s, 0.0, 1 - s, 0.0, "BENIGN") for hit, s in scores])
    got = {r["class"]: r for r in mt.ranking_metrics(table).collect()}
    pos, neg = [s for h, s in scores if h], [s for h, s in scores if not h]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got["BENIGN"]["roc_auc"] == pytest.approx(auc)
    ap = 0.0
    for cut in sorted({s for _, s in scores}):
        tp, fp = sum(p >= cut for p in pos), sum(n >= cut for n in neg)
        ap += sum(p == cut for p in pos) / len(pos) * tp / (tp + fp)
    assert got["BENIGN"]["average_precision"] == pytest.approx(ap)
    assert set(got) == {"BENIGN", "DoS"}
    assert mt.macro_ranking_metrics(mt.ranking_metrics(table)).first()["multiclass_roc_auc"] is None


def test_probability_quality_and_calibration(spark):
    table = predictions(spark, [("BENIGN", "BENIGN", 1.0, 0.0, 0.0, 0.0, "BENIGN"), ("DoS", "BENIGN", 0.6, 0.0, 0.4, 0.0, "BENIGN")])
    row = mt.probability_quality(table).first()
    assert row["multiclass_log_loss"] == pytest.approx(-math.log(0.4) / 2, abs=1e-6)
    assert row["multiclass_brier_score"] == pytest.approx(0.36)
    assert row["expected_calibration_error"] == pytest.approx(0.3)
    bins = {r["bin"]: r for r in mt.calibration(table).collect()}
    assert len(bins) == 10 and bins[9]["n"] == 1 and bins[0]["mean_confidence"] is None
    third = predictions(spark, [("BENIGN", "BENIGN", 0.3, 0.25, 0.25, 0.2, "BENIGN")])
    assert {r["bin"] for r in mt.calibration(third).where("n > 0").collect()} == {2}  # 0.3 lies below the edge 0.30000000000000004


def test_transition_metrics(spark):
    table = predictions(spark, [("DoS", "DoS", 0.1, 0.1, 0.7, 0.1, "BENIGN"), ("DoS", "BENIGN", 0.5, 0.1, 0.3, 0.1, "BENIGN")])
    row = mt.transition_metrics(table).first()
    assert (row["n"], row["correct"], row["accuracy"], row["low_support"]) == (2, 1, 0.5, True)
    assert row["mean_true_probability"] == pytest.approx(0.5)


def samples(spark, items):
    return spark.createDataFrame(
        [(i, y, [[b, 1 - b, 0.0, 0.0] for b in p], h) for i, (y, p, h) in enumerate(items)],
        "id long, y array<string>, p array<array<double>>, history array<string>",
    )


def test_threshold_prefers_lower_on_ties(spark):
    table = samples(spark, [(["BENIGN", "DDoS"], [0.95, 0.02], ["BENIGN"] * 5)])
    sweep = hz.threshold_sweep(hz.explode_horizons(table))
    assert hz.select_threshold(sweep).first()[0] == 0.5
    alarmed = samples(spark, [(["BENIGN", "BENIGN"], [0.0, 0.0], ["BENIGN"] * 5)])
    assert hz.select_threshold(hz.threshold_sweep(hz.explode_horizons(alarmed))).first()[0] is None


def test_onset_counts(spark):
    quiet = ["BENIGN"] * 5
    table = samples(spark, [
        (["BENIGN", "BENIGN", "DoS"], [0.9, 0.1, 0.1], quiet),
        (["BENIGN", "BENIGN", "BENIGN"], [0.9, 0.9, 0.1], quiet),
        (["DoS", "BENIGN", "BENIGN"], [0.9, 0.9, 0.9], quiet),
        (["DoS", "DoS", "DoS"], [0.1, 0.1, 0.1], ["DoS"] * 5),
    ])
    row = hz.onset_metrics(table, 0.5).first()
    assert (row["supported_onsets"], row["detected"], row["misses"], row["false_warnings"]) == (2, 1, 1, 1)
    assert (row["early_detections"], row["mean_horizon_error"], row["mean_lead_windows"]) == (1, -1.0, 1.0)


def test_horizons_and_degradation(spark):
    table = samples(spark, [(["BENIGN", "DDoS"], [0.9, 0.9], ["BENIGN"] * 5), (["DDoS", "DDoS"], [0.1, 0.1], ["BENIGN"] * 5)])
    out = hz.degradation(hz.horizon_metrics(hz.explode_horizons(table))).orderBy("horizon").collect()
    assert [r["accuracy"] for r in out] == [1.0, 0.5] and out[1]["accuracy_delta_from_h1"] == -0.5


def test_time_histogram_bins(spark):
    table = spark.sql("SELECT timestamp_seconds(60 * id) AS timestamp, if(id = 3, 'DoS', 'BENIGN') AS effective_state FROM range(4)")
    out = mt.time_histogram(table).orderBy("bin").collect()
    assert [(r["bin"], r["benign"], r["attack"]) for r in out] == [(0, 1, 0), (1, 1, 0), (2, 1, 1)]
