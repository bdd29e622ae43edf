"""Registered queries: ATT&CK context, kill-chain stages, models and sampling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netstate.catalog.scores import SAMPLES, horizon_samples
from netstate.catalog.shaping import HOUR, rounded
from netstate.catalog.sql import FLOWS, SCORED, states, with_ctes
from netstate.constants import FLOW_FEATURES as ALL_FEATURES
from netstate.constants import STATE_CLASSES, STATE_FEATURES
from netstate.operators import attack_context as ctx
from netstate.operators import horizons as hz
from netstate.operators import modeling as ml
from netstate.operators import sequences as seq
from netstate.operators import splits
from netstate.operators.metrics import PROBABILITIES, compare_models, summary_metrics
from netstate.operators.states import window_states
from netstate.scale import compile_in_parts, deal, stage
from netstate.sources.tables import derive_flows, derive_scored, feature_code, wide_sql

QUERIES = {}
ORACLE = {}
FLOW_FEATURES = [
    "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "syn_flag_cnt",
    "ack_flag_cnt", "psh_flag_cnt", "flow_iat_mean", "flow_iat_min", "pkt_size_avg", "pkt_len_max",
]
WIDE_FEATURES = [feature_code(i) for i in range(len(ALL_FEATURES))]


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


FORECASTS = """fc AS (SELECT s.session_id, window_id, dominant_state AS current_state, flow_count, unique_dst_port_count, flows_per_second * 3600 AS flows_per_second,
  packets_per_second * 400 AS packets_per_second, syn_count, rst_count, (1 + window_id * 3 % 7) / t AS p_benign, (1 + window_id * 5 % 7) / t AS p_ddos, (1 + window_id * 2 % 7) / t AS p_dos, (1 + window_id * 4 % 7) / t AS p_portscan
  FROM (SELECT *, 4.0E0 + window_id * 3 % 7 + window_id * 5 % 7 + window_id * 2 % 7 + window_id * 4 % 7 AS t FROM states) s)"""
CONTEXT = """c1 AS (SELECT *, CASE greatest(p_benign, p_ddos, p_dos, p_portscan) WHEN p_benign THEN 'BENIGN' WHEN p_ddos THEN 'DDoS' WHEN p_dos THEN 'DoS' ELSE 'PortScan' END AS predicted,
  greatest(p_benign, p_ddos, p_dos, p_portscan) AS best FROM fc),
c2 AS (SELECT *, current_state = 'BENIGN' AND predicted = 'BENIGN' AND 1.0E0 - p_benign < 0.5E0 AS quiet,
  CASE WHEN current_state <> 'BENIGN' THEN current_state WHEN predicted <> 'BENIGN' AND best >= 0.5E0 THEN predicted END AS guided,
  CASE WHEN current_state <> 'BENIGN' AND predicted <> 'BENIGN' AND predicted <> current_state THEN [current_state, predicted] WHEN current_state <> 'BENIGN' THEN [current_state]
    WHEN predicted <> 'BENIGN' THEN [predicted] ELSE [CASE greatest(p_portscan, p_ddos, p_dos) WHEN p_portscan THEN 'PortScan' WHEN p_ddos THEN 'DDoS' ELSE 'DoS' END] END AS examined FROM c1),
c3 AS (SELECT *, CASE guided WHEN 'DDoS' THEN 'high' WHEN 'DoS' THEN 'high' WHEN 'PortScan' THEN 'medium' ELSE 'informational' END AS severity FROM c2),
c4 AS (SELECT *, unnest(examined) AS state FROM c3 WHERE NOT quiet),
c5 AS (SELECT *, CASE state WHEN 'DDoS' THEN p_ddos WHEN 'DoS' THEN p_dos ELSE p_portscan END AS share, current_state = state AS cur,
  list_filter(CASE WHEN state = 'PortScan' THEN [
    CASE WHEN unique_dst_port_count >= 10 THEN 'destination-port diversity is elevated (' || printf('%g', unique_dst_port_count) || ' unique ports)' END,
    CASE WHEN flow_count > 0 AND unique_dst_port_count / flow_count >= 0.5E0 THEN 'destination-port diversity spans at least half of observed flows' END,
    CASE WHEN syn_count >= greatest(5, flow_count * 0.5E0) THEN 'repeated SYN behavior is present (' || printf('%g', syn_count) || ' SYN flags)' END]
  ELSE [CASE WHEN flows_per_second >= 10 THEN 'connection rate is elevated (' || printf('%g', flows_per_second) || ' flows/s)' END,
    CASE WHEN packets_per_second >= 100 THEN 'packet rate is elevated (' || printf('%g', packets_per_second) || ' packets/s)' END,
    CASE WHEN syn_count >= 20 THEN 'high SYN volume is present (' || printf('%g', syn_count) || ' SYN flags)' END,
    CASE WHEN rst_count >= 10 THEN 'high RST volume is present (' || printf('%g', rst_count) || ' RST flags)' END] END, lambda x: x IS NOT NULL) AS behaviour FROM c4),
c6 AS (SELECT *, len(behaviour) > 0 AND (cur OR share >= 0.5E0) AS possible,
  list_filter([CASE WHEN cur THEN 'observed current network state is ' || state END,
    CASE WHEN share >= 0.25E0 THEN 'LSTM next-state probability for ' || state || ' is ' || printf('%.3f', share) END], lambda x: x IS NOT NULL) AS observed FROM c5),
cand AS (SELECT session_id, window_id, current_state, predicted AS predicted_next_state, state, technique_id, technique_name, tactic,
  CASE WHEN possible AND NOT sub THEN 'POSSIBLE' ELSE 'INSUFFICIENT_EVIDENCE' END AS mapping_status,
  CASE WHEN possible AND sub THEN 0.25E0 WHEN possible AND cur AND share >= 0.5E0 THEN 0.65E0 WHEN possible THEN 0.55E0 ELSE 0.25E0 END AS mapping_confidence,
  array_to_string(list_concat(observed, behaviour), '; ') AS evidence, severity FROM c6 JOIN (VALUES ('PortScan', 'T1595', 'Active Scanning', 'Reconnaissance', FALSE), ('PortScan', 'T1046', 'Network Service Discovery', 'Discovery', FALSE),
  ('DDoS', 'T1498', 'Network Denial of Service', 'Impact', FALSE), ('DDoS', 'T1498.001', 'Direct Network Flood', 'Impact', TRUE), ('DDoS', 'T1498.002', 'Reflection Amplification', 'Impact', TRUE),
  ('DoS', 'T1499', 'Endpoint Denial of Service', 'Impact', FALSE)) v(state, technique_id, technique_name, tactic, sub) USING (state))"""


_LIMITS = "CASE technique_id " + " ".join(
    f"WHEN '{t}' THEN '{'; '.join([*ctx.GENERAL_LIMITATIONS, text])}'" for t, text in ctx.LIMITATIONS.items()
) + " END"


def _guidance_sql(part: int) -> str:
    """Texts for the state that a forecast points to."""
    cases = " ".join(f"WHEN '{state}' THEN '{'; '.join(texts[part])}'" for state, texts in ctx.GUIDANCE.items())
    return f"CASE guided {cases} ELSE '{'; '.join(ctx.DEFAULT_GUIDANCE[part])}' END"


def _forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Window states with made-to-measure probabilities derived from their ids."""
    shares = {n: 1 + F.col("window_id") * k % 7 for n, k in zip(PROBABILITIES, (3, 5, 2, 4))}
    total = sum(shares.values(), F.lit(0.0))
    rows = window_states(derive_flows(spark, d), HOUR).withColumns(
        {
            "flows_per_second": F.col("flows_per_second") * 3600,
            "packets_per_second": F.col("packets_per_second") * 400,
            "current_state": F.col("dominant_state"),
        }
    )
    return rows.withColumns({n: share / total for n, share in shares.items()})


@query(with_ctes(FLOWS, states(), FORECASTS, CONTEXT) + f"SELECT *, {_LIMITS} AS limitations FROM cand")
def attack_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = ctx.attack_candidates(_forecasts(spark, d), ["session_id", "window_id"])
    return out.withColumns({c: F.array_join(c, "; ") for c in ("evidence", "limitations")})


@query(
    with_ctes(FLOWS, states(), FORECASTS, CONTEXT, "best AS (SELECT session_id, window_id, bool_or(mapping_status = 'POSSIBLE') AS p, max(mapping_confidence) AS m FROM cand GROUP BY 1, 2)")
    + """SELECT c.session_id, c.window_id, current_state, predicted AS predicted_next_state, severity, CASE WHEN p THEN 'POSSIBLE' ELSE 'INSUFFICIENT_EVIDENCE' END AS mapping_status, m AS mapping_confidence,
  CASE WHEN quiet THEN 'no attack evidence' WHEN p THEN 'network-flow evidence supports possible ATT&CK context' ELSE 'traffic-state evidence is insufficient for an ATT&CK technique assertion' END AS reason,
  """ + _guidance_sql(1) + " AS operator_guidance, " + _guidance_sql(2) + """ AS evidence_needed
  FROM c3 c LEFT JOIN best USING (session_id, window_id)"""
)
def attack_mapping(spark: SparkSession, d: str) -> DataFrame:
    keys = ["session_id", "window_id"]
    forecasts = stage(_forecasts(spark, d))
    out = ctx.mapping_summary(forecasts, ctx.attack_candidates(forecasts, keys), keys)
    return out.withColumns({c: F.array_join(c, "; ") for c in ("operator_guidance", "evidence_needed")})


@query(
    with_ctes(FLOWS, SCORED, SAMPLES, """st AS (SELECT hp.session_id, hp.flow_seq, horizon, round(1.0E0 - p_benign, 4) AS inf, CASE hp.y_pred WHEN 'BENIGN' THEN -1 WHEN 'PortScan' THEN 0 ELSE 5 END AS r,
  CASE s.hist[5] WHEN 'BENIGN' THEN -1 WHEN 'PortScan' THEN 0 ELSE 5 END AS c FROM hp JOIN samples s USING (session_id, flow_seq))""",
              "g AS (SELECT session_id, flow_seq, max(inf) AS infiltration_probability, coalesce(min(horizon) FILTER (WHERE inf >= 0.6E0), 0) AS earliest_alarm_step, max(greatest(r, c)) AS rung FROM st GROUP BY 1, 2)")
    + """SELECT session_id, flow_seq, infiltration_probability, CAST(earliest_alarm_step AS INT) AS earliest_alarm_step, CASE rung WHEN -1 THEN 'Benign' WHEN 0 THEN 'Reconnaissance' ELSE 'Impact' END AS most_advanced_stage,
  CASE rung WHEN -1 THEN NULL WHEN 0 THEN 'TA0043' ELSE 'TA0040' END AS tactic_id, CASE WHEN infiltration_probability >= 0.8E0 THEN 'high' WHEN infiltration_probability >= 0.5E0 THEN 'medium' ELSE 'low' END AS risk_level FROM g"""
)
def kill_chain(spark: SparkSession, d: str) -> DataFrame:
    samples = horizon_samples(spark, d).withColumn("current_state", F.element_at("history", -1))
    steps = hz.explode_horizons(samples, ["session_id", "flow_seq", "current_state"])
    out = ctx.forecast_stages(steps, ["session_id", "flow_seq"], step="horizon")
    return out.withColumn("earliest_alarm_step", F.coalesce("earliest_alarm_step", F.lit(0)))


@query(
    with_ctes(FLOWS, "k AS (SELECT current_state, count(*) AS n FROM flows WHERE current_state <> 'INVALID_FEATURES' GROUP BY 1)")
    + "SELECT current_state, n AS support, round(least((SELECT sum(n) FROM k) / ((SELECT count(*) FROM k) * n), 5), 6) AS weight FROM k"
)
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    flows = derive_flows(spark, d).where(F.col("current_state").isin(STATE_CLASSES))
    return rounded(ml.class_weights(flows, "current_state"), ["weight"])


def _prune_sql() -> str:
    rows = []
    for j, name in enumerate(FLOW_FEATURES):
        earlier = ", ".join(f"abs(corr({e}, {name}))" for e in FLOW_FEATURES[:j])
        top = f"greatest({earlier})" if earlier else "0.0E0"
        rows.append(f"SELECT '{name}' AS feature, round({top}, 6) AS max_earlier_correlation, {top} > 0.7E0 AS dropped FROM flows")
    rows[0] = rows[0].replace(" FROM flows", "")
    return " UNION ALL ".join(rows)


@query(with_ctes(FLOWS) + _prune_sql())
def correlation_prune(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ml.correlation_prune(derive_flows(spark, d), FLOW_FEATURES), ["max_earlier_correlation"])


@query()
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    flows = derive_flows(spark, d).select("flow_seq", "current_state")
    return ml.stratified_sample(flows.where(F.col("current_state").isin(STATE_CLASSES)), "current_state", "flow_seq")


@query(
    with_ctes(FLOWS, SCORED, "q AS (SELECT flow_seq, row_number() OVER (ORDER BY flow_seq) AS r, count(*) OVER () AS n FROM scored WHERE y_pred = 'BENIGN')")
    + """SELECT arg_min(flow_seq, (p_benign, flow_seq)) AS flow_seq, 'most attack-like' AS reason FROM scored UNION ALL SELECT flow_seq, 'middle benign' FROM q WHERE r = n // 2 + 1"""
)
def rows_to_explain(spark: SparkSession, d: str) -> DataFrame:
    return ml.rows_to_explain(derive_scored(spark, d), "flow_seq")


#: Values of flow_seq in one bucket of the split. A class fills few buckets of the usual width, and a task reads a whole one.
SPLIT_BITS = 16


def _flow_vectors(spark: SparkSession, d: str, stored: bool = True) -> tuple[DataFrame, DataFrame, object]:
    """All 77 features of the scoreable flows; the one with infinite values takes part where it is finite.

    The flows are split before they get their features. Fits pass over the vectors many times, so these are dealt evenly and
    stored; trees store the bins of the features instead.
    """
    compile_in_parts(spark)
    flows = derive_flows(spark, d).where(F.col("current_state").isin(STATE_CLASSES))
    parts = stage(splits.split_within_class(flows, "current_state", "flow_seq", bits=SPLIT_BITS))
    wide = spark.sql(wide_sql("{flows}", ["split"]), flows=deal(parts))
    scaler = splits.fit_min_max(wide.where(F.col("split") == "train"), WIDE_FEATURES)
    vectors = ml.to_vectors(wide, WIDE_FEATURES, "current_state", scaler).select(
        "flow_seq", "split", F.col("current_state").alias("y_true"), "features", "label"
    )
    vectors = stage(vectors) if stored else vectors
    return vectors.where(F.col("split") == "train"), vectors.where(F.col("split") == "validation"), scaler


@query()
def flow_network(spark: SparkSession, d: str) -> DataFrame:
    train, validation, _ = _flow_vectors(spark, d)
    model = ml.fit_flow_network(train, len(WIDE_FEATURES))
    return summary_metrics(ml.with_probabilities(model.transform(validation)))


@query()
def flow_challenger(spark: SparkSession, d: str) -> DataFrame:
    train, validation, _ = _flow_vectors(spark, d, stored=False)
    weighted = ml.with_class_weights(train, "y_true", cap=None)
    model = ml.fit_challenger(weighted)
    table = F.array(*[F.lit(c) for c in STATE_CLASSES])
    scored = model.transform(validation).withColumn("y_pred", F.get(table, F.col("prediction").cast("int")))
    return summary_metrics(scored)


@query()
def tree_importance(spark: SparkSession, d: str) -> DataFrame:
    train, _, _ = _flow_vectors(spark, d, stored=False)
    best = ml.tree_search(train, "tree", choices=6, folds=3).bestModel
    weak = set(ml.weak_features(best, ALL_FEATURES))
    rows = [(f, float(v), f in weak) for f, v in zip(ALL_FEATURES, best.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double, below_floor boolean")


def _forecast_parts(spark: SparkSession, d: str):
    whole = stage(window_states(derive_flows(spark, d), HOUR))
    parts = stage(splits.final_split(whole))
    return whole, parts, stage(seq.sequences_gap_aware(parts, within=["split"], features=STATE_FEATURES))


@query()
def next_window_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts of the held-out windows of every session."""
    _, parts, sequences = _forecast_parts(spark, d)
    train = F.col("split") == "train"
    model = ml.fit_next_window(sequences.where(train), parts.where(train))
    scored = model.transform(sequences.where(F.col("split") == "test"))
    return scored.select(
        "session_id", "target_window_id", F.col("y_dominant_state").alias("y_true"), "y_pred", "alert_pred",
        *PROBABILITIES, "attack_probability",
    )


@query()
def multistep_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts for six windows ahead over a session split with an embargo."""
    whole = stage(window_states(derive_flows(spark, d), HOUR))
    buckets = {"s1": "train", "s2": "train", "s3": "validation"}
    parts = stage(splits.embargo_split(whole, buckets, "s4"))
    samples = stage(seq.multistep_sequences(parts, within=["split"], features=STATE_FEATURES))
    train = F.col("split") == "train"
    fitted = ml.fit_multistep(samples.where(train), parts.where(train), features=STATE_FEATURES)
    return ml.predict_multistep(samples.where(~train), fitted, ["split", "sample_id"], STATE_FEATURES)


@query()
def state_rollout(spark: SparkSession, d: str) -> DataFrame:
    """Six autoregressive steps from the latest windows of every session."""
    whole, parts, sequences = _forecast_parts(spark, d)
    train = F.col("split") == "train"
    scaler = splits.fit_min_max(parts.where(train), STATE_FEATURES)
    pairs = seq.next_state_pairs(parts.where(train).drop("split"), features=STATE_FEATURES)
    regression = ml.fit_lag_regression(pairs, scaler, STATE_FEATURES)
    vectors = ml.flat_history(sequences.where(train), scaler, STATE_FEATURES)
    labelled = vectors.select("features", ml.encode_label(F.col("y_dominant_state"), STATE_CLASSES).cast("double").alias("label"))
    model = ml.fit_logistic(labelled)
    latest = seq.recent_windows(whole)
    histories = latest.groupBy("session_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("window_id", F.array(*[F.col(f) for f in STATE_FEATURES]).alias("v")))), lambda s: s["v"]
        ).alias("X"),
        F.max_by("dominant_state", "window_id").alias("current_state"),
    )
    return ml.rollout(histories, scaler, model, regression, ["session_id", "current_state"], features=STATE_FEATURES)


@query()
def driving_features(spark: SparkSession, d: str) -> DataFrame:
    train, validation, _ = _flow_vectors(spark, d)
    model = ml.fit_logistic(train)
    return ml.driving_features(ml.linear_contributions(validation, model, ALL_FEATURES, ["flow_seq"]))


@query()
def top_flow_features(spark: SparkSession, d: str) -> DataFrame:
    train, validation, _ = _flow_vectors(spark, d)
    model = ml.fit_logistic(train)
    return ml.top_features(ml.linear_contributions(validation, model, ALL_FEATURES, ["flow_seq"]), ["flow_seq"])


@query()
def forest_search(spark: SparkSession, d: str) -> DataFrame:
    """Random forest of the best of ten grid points, on held-out flows."""
    train, validation, _ = _flow_vectors(spark, d, stored=False)
    best = ml.tree_search(train, "forest", choices=10, folds=3).bestModel
    table = F.array(*[F.lit(c) for c in STATE_CLASSES])
    scored = best.transform(validation).withColumn("y_pred", F.get(table, F.col("prediction").cast("int")))
    return summary_metrics(scored)


@query()
def logistic_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Class-weighted logistic regression over whole histories against the forecaster, per metric."""
    _, parts, sequences = _forecast_parts(spark, d)
    train, test = F.col("split") == "train", F.col("split") == "test"
    forecaster = ml.fit_next_window(sequences.where(train), parts.where(train))
    baseline = ml.fit_next_window(sequences.where(train), parts.where(train), capped=True)
    rows = None
    for name, model in (("forecaster", forecaster), ("baseline", baseline)):
        scored = model.transform(sequences.where(test)).select(
            F.lit(name).alias("model"), F.col("y_dominant_state").alias("y_true"), "y_pred"
        )
        rows = scored if rows is None else rows.unionByName(scored)
    metrics = summary_metrics(rows, ["model"])
    return compare_models(metrics, ["forecaster", "baseline"], ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1"])


#: Coefficients for the steps that follow a fit: class by feature, and intercepts.
GIVEN = ml.LinearModel(
    tuple(tuple((((5 * c + 2 * i) % 7) - 3) / 8 for i in range(len(FLOW_FEATURES))) for c in range(4)), (0.5, 0.0, 0.25, -0.25)
)
GIVEN_SCALER = splits.MinMaxModel({f: 0.0 for f in FLOW_FEATURES}, {f: 50.0 + i for i, f in enumerate(FLOW_FEATURES)}, 1)


def _float(value: float) -> str:
    text = repr(float(value))
    return text if "e" in text else f"{text}E0"


_GIVEN_X = ", ".join(f"(CAST({f} AS DOUBLE) - 0.0E0) * {_float(1 / (50.0 + i))} AS x{i}" for i, f in enumerate(FLOW_FEATURES))
_GIVEN_Z = ", ".join(
    " + ".join([_float(GIVEN.intercepts[c]), *[f"x{i} * {_float(GIVEN.coefficients[c][i])}" for i in range(len(FLOW_FEATURES))]]) + f" AS z{c}"
    for c in range(4)
)
GIVEN_CTES = (
    FLOWS, f"gx AS (SELECT flow_seq, current_state, {_GIVEN_X} FROM flows)", f"gz AS (SELECT *, {_GIVEN_Z} FROM gx)",
    "gm AS (SELECT *, greatest(z0, z1, z2, z3) AS m FROM gz)",
    "gp AS (SELECT *, CASE m WHEN z0 THEN 0 WHEN z1 THEN 1 WHEN z2 THEN 2 ELSE 3 END AS k, exp(z0 - m) + exp(z1 - m) + exp(z2 - m) + exp(z3 - m) AS t FROM gm)",
    "gc AS (" + " UNION ALL ".join(
        f"SELECT flow_seq, '{f}' AS feature, x{i} * CASE k " + " ".join(f"WHEN {c} THEN {_float(GIVEN.coefficients[c][i])}" for c in range(4)) + " END AS contribution FROM gp"
        for i, f in enumerate(FLOW_FEATURES)
    ) + ")",
    "gr AS (SELECT *, row_number() OVER (PARTITION BY flow_seq ORDER BY abs(contribution) DESC, feature) AS rank FROM gc)",
)


def _given_vectors(spark: SparkSession, d: str) -> DataFrame:
    inputs = F.array(*[GIVEN_SCALER.scaled(f, F.col(f).cast("double")) for f in FLOW_FEATURES])
    return derive_flows(spark, d).select("flow_seq", "current_state", array_to_vector(inputs).alias("features"))


def _given_contributions(spark: SparkSession, d: str) -> DataFrame:
    return ml.linear_contributions(_given_vectors(spark, d), GIVEN, FLOW_FEATURES, ["flow_seq"])


@query(
    with_ctes(*GIVEN_CTES)
    + """SELECT flow_seq, CASE k WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DDoS' WHEN 2 THEN 'DoS' ELSE 'PortScan' END AS y_pred, round(exp(z0 - m) / t, 6) AS p_benign, round(exp(z1 - m) / t, 6) AS p_ddos,
  round(exp(z2 - m) / t, 6) AS p_dos, round(exp(z3 - m) / t, 6) AS p_portscan FROM gp"""
)
def linear_scores(spark: SparkSession, d: str) -> DataFrame:
    """Class probabilities of given coefficients."""
    return rounded(ml.with_probabilities(GIVEN.transform(_given_vectors(spark, d))).drop("features", "current_state"), PROBABILITIES)


@query(with_ctes(*GIVEN_CTES) + "SELECT flow_seq, CAST(rank AS INT) AS rank, feature, round(contribution, 6) + 0.0E0 AS contribution FROM gr WHERE rank <= 8")
def linear_top_features(spark: SparkSession, d: str) -> DataFrame:
    top = ml.top_features(_given_contributions(spark, d), ["flow_seq"])
    return top.withColumn("contribution", F.col("contribution") + F.lit(0.0))


@query(
    with_ctes(*GIVEN_CTES)
    + """SELECT flow_seq, CAST(rank AS INT) AS rank, feature, round(contribution, 9) + 0.0E0 AS contribution, CASE WHEN contribution >= 0 THEN 'increase' ELSE 'decrease' END AS direction FROM gr"""
)
def linear_ranked_features(spark: SparkSession, d: str) -> DataFrame:
    ranked = rounded(ml.ranked_contributions(_given_contributions(spark, d), ["flow_seq"]), ["contribution"], 9)
    return ranked.withColumn("contribution", F.col("contribution") + F.lit(0.0))  # no negative zero


@query(
    with_ctes(*GIVEN_CTES)
    + """SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs_contribution, round(avg(contribution), 6) AS mean_signed_contribution FROM gc GROUP BY 1 ORDER BY avg(abs(contribution)) DESC, feature LIMIT 10"""
)
def linear_driving_features(spark: SparkSession, d: str) -> DataFrame:
    return ml.driving_features(_given_contributions(spark, d))


@query(
    with_ctes(FLOWS, "k AS (SELECT current_state AS c, count(*) AS n FROM flows WHERE current_state <> 'INVALID_FEATURES' GROUP BY 1)",
        "s AS (SELECT c, n, sum(n) OVER () AS total, greatest(1, CAST(floor(least(100, sum(n) OVER ()) * n / sum(n) OVER ()) AS BIGINT)) AS a FROM k)",
        # All shares together miss at most a few samples; these go where most rows are left over.
        "m AS (SELECT least(100, any_value(total)) - sum(a) AS missing FROM s)",
        "g AS (SELECT c, row_number() OVER (ORDER BY n - a - i DESC, c) AS r FROM s, range(0, 4) t(i))")
    + "SELECT c AS current_state, CAST(a + (SELECT count(*) FROM g WHERE g.c = s.c AND r <= (SELECT missing FROM m)) AS BIGINT) AS samples FROM s"
)
def sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows per class of the stratified sample."""
    return stratified_sample(spark, d).groupBy("current_state").agg(F.count(F.lit(1)).alias("samples"))


@query(
    with_ctes(FLOWS, states(), FORECASTS, CONTEXT)
    + """SELECT session_id, window_id, technique_id, row_number() OVER (PARTITION BY session_id, window_id ORDER BY mapping_confidence DESC, technique_id) AS rank
  FROM (SELECT session_id, window_id, technique_id, max(mapping_confidence) AS mapping_confidence FROM cand GROUP BY 1, 2, 3)"""
)
def ranked_techniques(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each forecast, most confident first; a forecast has six techniques at most."""
    keys = ["session_id", "window_id"]
    best = ctx.attack_candidates(_forecasts(spark, d), keys).groupBy(*keys, "technique_id").agg(
        F.max("mapping_confidence").alias("mapping_confidence")
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("mapping_confidence"), "technique_id")
    return ctx.ranked_candidates(best).select(*keys, "technique_id", F.row_number().over(order).cast("long").alias("rank"))


@query(
    with_ctes(FLOWS)
    + """SELECT flow_seq, CASE current_state WHEN 'BENIGN' THEN 'Benign' WHEN 'PortScan' THEN 'Reconnaissance' WHEN 'INVALID_FEATURES' THEN 'Unknown' ELSE 'Impact' END AS stage,
  CASE current_state WHEN 'PortScan' THEN 'Reconnaissance' WHEN 'DoS' THEN 'Impact' WHEN 'DDoS' THEN 'Impact' ELSE '' END AS active_rungs,
  current_state IN ('DoS', 'DDoS') AND flow_seq % 100 >= 80 AS terminal_impact_alert, CASE WHEN current_state IN ('DoS', 'DDoS') THEN 'TA0040' ELSE '' END AS terminal_tactic_id FROM flows"""
)
def stage_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Ladder and terminal alert of every flow's stage."""
    stage_of = ctx.state_to_stage(F.col("current_state"))
    shown = ctx.stage_presentation(stage_of, ctx.risk_level(F.col("flow_seq") % 100 / 100.0))
    rows = derive_flows(spark, d).select("flow_seq", shown.alias("s"))
    active = F.transform(F.filter("s.progress_stages", lambda r: r["active"]), lambda r: r["name"])
    return rows.select(
        "flow_seq", F.col("s.predicted_stage").alias("stage"), F.array_join(active, ",").alias("active_rungs"),
        F.col("s.terminal_impact_alert"), F.coalesce("s.terminal_tactic_id", F.lit("")).alias("terminal_tactic_id"),
    )
