import pytest
from pyspark.sql import functions as F
from tests.helpers import flow, flows, windows

from netstate.constants import STATE_CLASSES
from netstate.operators import modeling as ml
from netstate.operators import sequences as seq
from netstate.operators import splits
from netstate.plans.forecasting import evaluate_against_persistence, select_weighting, walk_forward
from netstate.plans.label_flows import capture_report, label_flows

FEATURES = ["flow_count", "syn_count"]


def cycle(spark, n=120):
    states = [STATE_CLASSES[i // 5 % 4] for i in range(n)]
    table = windows(spark, range(n), states=states)
    code = F.coalesce(*[F.when(F.col("dominant_state") == c, F.lit(float(i))) for i, c in enumerate(STATE_CLASSES)])
    return table.withColumns({"flow_count": code, "syn_count": F.col("window_id") % 5 * 1.0})


def test_weights_and_allocation(spark):
    rows = spark.sql("SELECT if(id < 90, 'BENIGN', if(id < 99, 'DoS', 'DDoS')) AS c FROM range(100)")
    weights = {r["c"]: r["weight"] for r in ml.class_weights(rows, "c").collect()}
    assert weights["DDoS"] == 5.0 and weights["BENIGN"] == pytest.approx(100 / 270)
    assert ml.sample_allocation({"a": 150, "b": 50}, 100) == {"a": 75, "b": 25}
    assert ml.sample_allocation({"a": 9999, "b": 1}, 100) == {"a": 99, "b": 1}
    assert ml.sample_allocation({"a": 3, "b": 2}, 100) == {"a": 3, "b": 2}


def test_sample_is_stratified_and_repeatable(spark):
    rows = spark.sql("SELECT id, if(id < 150, 'a', 'b') AS c FROM range(200)")
    first = ml.stratified_sample(rows, "c", "id")
    assert {r["c"]: r["count"] for r in first.groupBy("c").count().collect()} == {"a": 75, "b": 25}
    again = ml.stratified_sample(rows.repartition(7), "c", "id")
    assert sorted(first.collect()) == sorted(again.collect())


def test_correlation_prune(spark):
    rows = spark.sql("SELECT id * 1.0D AS a, id * 2.0D + 1 AS b, (id * 7919 % 13) * 1.0D AS c FROM range(50)")
    out = {r["feature"]: r["dropped"] for r in ml.correlation_prune(rows, ["a", "b", "c"]).collect()}
    assert out == {"a": False, "b": True, "c": False}


def test_contributions(spark):
    rows = spark.sql("SELECT id, if(id % 2 = 0, 'BENIGN', 'DoS') AS s, if(id % 2 = 0, 0.0D, 10.0D) AS x, 1.0D AS y FROM range(40)")
    scaler = splits.fit_min_max(rows, ["x", "y"])
    vectors = ml.to_vectors(rows, ["x", "y"], "s", scaler).withColumn("label", F.when(F.col("s") == "DoS", 1.0).otherwise(0.0))
    model = ml.fit_logistic(vectors.select("features", "label"), 20)
    out = ml.linear_contributions(vectors.select("id", "features"), model, ["x", "y"], ["id"])
    assert ml.driving_features(out).first()["feature"] == "x"
    assert ml.top_features(out, ["id"], 1).where("feature = 'y' and id % 2 = 1").isEmpty()
    first = ml.ranked_contributions(out.where("id = 1"), ["id"]).orderBy("rank").first()
    assert (first["feature"], first["direction"]) == ("x", "increase")


def test_forecast_and_rollout(spark):
    table = cycle(spark)
    sequences = seq.sequences_gap_aware(table, features=FEATURES)
    model = ml.fit_next_window(sequences, table, FEATURES, iterations=50)
    scored = model.transform(sequences)
    assert scored.where("y_pred = y_dominant_state").count() / scored.count() > 0.7
    total = scored.select(F.max(F.abs(F.col("p_benign") + F.col("p_ddos") + F.col("p_dos") + F.col("p_portscan") - 1))).first()[0]
    assert total < 1e-9
    scaler = splits.fit_min_max(table, FEATURES)
    regression = ml.fit_lag_regression(seq.next_state_pairs(table, features=FEATURES), scaler, FEATURES)
    out = ml.rollout(sequences.limit(3), scaler, model.state_model, regression, ["target_window_id"], steps=4, features=FEATURES)
    assert out.count() == 12 and {r["step"] for r in out.collect()} == {1, 2, 3, 4}


def test_lag_regression_recovers_a_line(spark):
    table = windows(spark, range(60))
    scaler = splits.fit_min_max(table, ["flow_count"])
    regression = ml.fit_lag_regression(seq.next_state_pairs(table, features=["flow_count"]), scaler, ["flow_count"])
    history = spark.range(1).select(F.array(*[F.array(F.lit(i / 59)) for i in range(5)]).alias("h"))
    assert history.select(regression.next_vector(F.col("h"))[0]).first()[0] == pytest.approx(5 / 59, abs=1e-3)


def test_walk_forward_and_gates(spark):
    table = cycle(spark)
    folds = walk_forward(table, FEATURES, iterations=5)
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {1, 2, 3}
    both, gates = evaluate_against_persistence(table, FEATURES, iterations=10)
    assert both.select("model").distinct().count() == 2 and gates.count() == 4


def test_labelling_keeps_unscoreable_rows(spark):
    rows = [flow(i, tot_fwd_pkts=float(i), flow_pkts_s=float("inf") if i == 3 else 1.0) for i in range(20)]
    table = flows(spark, rows)
    features = ["tot_fwd_pkts", "flow_pkts_s"]
    scaler = splits.fit_min_max(table.where("flow_seq <> 3"), features)
    train = table.where("flow_seq <> 3").withColumn("current_state", F.when(F.col("flow_seq") < 10, "BENIGN").otherwise("DDoS"))
    model = ml.fit_logistic(ml.to_vectors(train, features, "current_state", scaler).select("features", "label"), 30)
    out = label_flows(table, model, scaler, features)
    got = {r["flow_seq"]: r for r in out.collect()}
    assert len(got) == 20 and got[3]["current_state"] == "INVALID_FEATURES" and got[3]["confidence"] is None
    assert got[0]["current_state"] == "BENIGN" and got[19]["current_state"] == "DDoS"
    assert capture_report(out).count() == 2


def test_rows_to_explain(spark):
    rows = spark.sql("SELECT id, if(id < 7, 'BENIGN', 'DoS') AS y_pred, if(id = 8, 0.0D, 0.5D) AS p_benign FROM range(10)")
    assert {r["reason"]: r["id"] for r in ml.rows_to_explain(rows, "id").collect()} == {"most attack-like": 8, "middle benign": 3}


def test_searches_run_in_full(spark, monkeypatch):
    fitted = []
    for kind in (ml.OneVsRest, ml.CrossValidator):
        monkeypatch.setattr(kind, "fit", lambda self, vectors: fitted.append(self))
    ml.fit_challenger(None)
    ml.tree_search(None, "forest")
    challenger, search = fitted
    assert challenger.getClassifier().getMaxIter() == 180
    trees = [v for point in search.getEstimatorParamMaps() for p, v in point.items() if p.name == "numTrees"]
    assert len(trees) == 10 and max(trees) > 200


def test_weighting_without_a_fold_is_the_plain_one(spark):
    assert select_weighting(windows(spark, range(4))) == "unweighted"
