"""Models on Spark ML: flow classifiers, window forecasters, rollouts, contributions and sampling."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netstate.constants import (
    ALARM_PROBABILITY, ALERT_CLASSES, HORIZONS, ROLLOUT_STEPS, SEED, SEQUENCE_LENGTH, STATE_CLASSES,
    STATE_FEATURES,
)
from netstate.functions.values import encode_label
from netstate.operators import trees as grown
from netstate.operators.metrics import PROBABILITIES
from netstate.operators.splits import MinMaxModel, fit_min_max

HIDDEN_LAYERS = [128, 128, 64, 64, 32, 32, 16, 16]
IMPORTANCE_FLOOR = 0.01
CORRELATION_LIMIT = 0.7
WEIGHT_CAP = 5.0


def class_weights(rows: DataFrame, label: str, cap: float | None = WEIGHT_CAP) -> DataFrame:
    """Balanced weight n / (classes * n_class) of each present class, at most `cap`."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weight = F.lit(float(totals["n"] or 0)) / (F.lit(totals["k"] or 1) * F.col("_n"))
    weight = F.least(weight, F.lit(float(cap))) if cap is not None else weight
    return counts.select(label, F.col("_n").alias("support"), weight.alias("weight"))


def with_class_weights(rows: DataFrame, label: str, classes: Sequence[str] = STATE_CLASSES, cap: float | None = WEIGHT_CAP) -> DataFrame:
    """Rows with their class weight: one literal per class, no join."""
    table = {r[label]: r["weight"] for r in class_weights(rows.where(F.col(label).isin(list(classes))), label, cap).collect()}
    chain = F.coalesce(*[F.when(F.col(label) == c, F.lit(w)) for c, w in table.items()], F.lit(1.0))
    return rows.withColumn("weight", chain)


def to_vectors(rows: DataFrame, features: Sequence[str], label: str, scaler: MinMaxModel, classes: Sequence[str] = STATE_CLASSES) -> DataFrame:
    """Scaled feature vector and class index; rows with a missing feature or another label are left out."""
    complete = rows.dropna(subset=list(features)).where(F.col(label).isin(list(classes)))
    vector = array_to_vector(F.array(*[scaler.scaled(f) for f in features]))
    return complete.withColumns({"features": vector, "label": encode_label(F.col(label), list(classes)).cast("double")})


def with_probabilities(scored: DataFrame, names: Sequence[str] = PROBABILITIES, classes: Sequence[str] = STATE_CLASSES, prediction: str = "y_pred") -> DataFrame:
    """Probability columns per class and the predicted class name, from ML output columns."""
    table = F.array(*[F.lit(c) for c in classes])
    present = vector_to_array("probability")
    out = scored.withColumn("_p", present)
    out = out.withColumns({n: F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)) for i, n in enumerate(names)})
    return out.withColumn(prediction, F.get(table, F.col("prediction").cast("int"))).drop("_p", "rawPrediction", "probability", "prediction")


def fit_flow_network(vectors: DataFrame, inputs: int, hidden: Sequence[int] = HIDDEN_LAYERS, iterations: int = 100, seed: int = SEED):
    """Feed-forward flow classifier with four outputs."""
    network = MultilayerPerceptronClassifier(
        layers=[inputs, *hidden, len(STATE_CLASSES)], maxIter=iterations, seed=seed, blockSize=128
    )
    return network.fit(vectors)


def _classes(vectors: DataFrame) -> int:
    return int(vectors.agg(F.max("label")).first()[0]) + 1


class SharedOneVsRest(OneVsRest):
    """Boosted trees, one class against the rest, whose rounds pass over the rows once a level for all classes."""

    def _fit(self, dataset: DataFrame) -> grown.TreeModel:
        trees = self.getClassifier()
        rows = grown.Rows(dataset, self.getWeightCol(), 1, trees.getSeed())
        fitted = grown.boosted(rows, _classes(dataset), trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize(), trees.getSeed())
        return grown.TreeModel(fitted, tuple(rows.cuts))


class SharedCrossValidator(CrossValidator):
    """A search over trees or forests that bins the rows once and grows a tree that several grid points have in common once.

    Trees of a forest are seeded by their number, so that a smaller forest is the beginning of a larger one; a shallow tree is
    the top of a deep one.
    """

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        folds, classes = self.getNumFolds(), _classes(dataset)
        points = [self.getEstimator().copy(p) for p in self.getEstimatorParamMaps()]
        rows = grown.Rows(dataset, None, folds, self.getSeed())
        single = not isinstance(points[0], RandomForestClassifier)
        deepest = max(p.getMaxDepth() for p in points)

        def specs(point, fold: int, depth: int) -> list[grown.Spec]:
            if single:
                return [grown.Spec(point.getImpurity(), depth, classes, point.getSeed(), fold=fold)]
            n = rows.features
            subset = {"all": 0, "sqrt": int(np.ceil(np.sqrt(n))), "log2": max(1, int(np.ceil(np.log2(n))))}[point.getFeatureSubsetStrategy()]
            return [
                grown.Spec(point.getImpurity(), depth, classes, point.getSeed(), i, fold, subset, bag=True) for i in range(point.getNumTrees())
            ]

        wanted = list(dict.fromkeys(s for p in points for fold in range(folds) for s in specs(p, fold, deepest)))
        trees = dict(zip(wanted, rows.grown(wanted)))
        fits = [
            (fold, grown.Forest(tuple(trees[s] for s in specs(p, fold, deepest)), classes, p.getMaxDepth())) for p in points for fold in range(folds)
        ]
        shares = np.array([right / max(1, all_) for right, all_ in rows.correct(fits)]).reshape(len(points), folds)
        metrics = shares.mean(1)
        best = points[int(np.argmax(metrics))]
        chosen = tuple(t.pruned() for t in rows.grown(specs(best, -1, best.getMaxDepth())))
        return CrossValidatorModel(grown.TreeModel(grown.Forest(chosen, classes), tuple(rows.cuts)), metrics.tolist(), None, shares.std(1).tolist())


def fit_challenger(vectors: DataFrame, rounds: int = 180, seed: int = SEED):
    """Gradient-boosted trees, one against the rest, with balanced class weights in column `weight`."""
    trees = GBTClassifier(maxIter=rounds, maxDepth=5, stepSize=0.08, seed=seed)
    return SharedOneVsRest(classifier=trees, weightCol="weight", parallelism=len(STATE_CLASSES)).fit(vectors)


def tree_search(vectors: DataFrame, kind: str = "forest", choices: int = 10, folds: int = 3, seed: int = SEED):
    """Randomised search over a fixed tree grid with cross-validated accuracy."""
    if kind == "forest":
        model = RandomForestClassifier(seed=seed)
        grid = [
            {model.numTrees: trees, model.impurity: impurity, model.featureSubsetStrategy: subset}
            for trees in (10, 50, 100, 200, 300, 400, 500)
            for impurity in ("gini", "entropy")
            for subset in ("all", "sqrt", "log2")
        ]
    else:
        model = DecisionTreeClassifier(seed=seed)
        grid = [
            {model.impurity: impurity, model.maxDepth: depth} for impurity in ("gini", "entropy") for depth in (5, 10, 15)
        ]
    sampled = random.Random(seed).sample(grid, min(choices, len(grid)))
    search = SharedCrossValidator(
        estimator=model, estimatorParamMaps=sampled, numFolds=folds, seed=seed, parallelism=2,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
    )
    return search.fit(vectors)


def weak_features(model, features: Sequence[str], floor: float = IMPORTANCE_FLOOR) -> list[str]:
    """Features whose tree importance lies below `floor`."""
    return [f for f, v in zip(features, model.featureImportances.toArray()) if v < floor]


def correlation_matrix(rows: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Pearson correlations of the features, gathered as one small square matrix."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(rows.select(*features))
    return Correlation.corr(assembled, "_v").first()[0].toArray()


def correlation_prune(rows: DataFrame, features: Sequence[str], limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Each feature with its largest absolute correlation to an earlier feature, and whether that drops it."""
    matrix = np.abs(correlation_matrix(rows, features))
    out = []
    for j, name in enumerate(features):
        earlier = matrix[:j, j]
        earlier = earlier[~np.isnan(earlier)]
        top = float(earlier.max()) if earlier.size else 0.0
        out.append((name, top, bool(top > limit)))
    return rows.sparkSession.createDataFrame(out, "feature string, max_earlier_correlation double, dropped boolean")


def flat_history(sequences: DataFrame, scaler: MinMaxModel, features: Sequence[str] = STATE_FEATURES, column: str = "X") -> DataFrame:
    """Scaled histories flattened to one vector per sample."""
    scaled = scaler.transform_vectors(F.col(column), features)
    return sequences.withColumn("features", array_to_vector(F.flatten(scaled)))


def fit_logistic(vectors: DataFrame, iterations: int = 100, weight: str | None = None):
    """Multinomial logistic regression over class indices."""
    model = LogisticRegression(family="multinomial", maxIter=iterations)
    return (model.setWeightCol(weight) if weight else model).fit(vectors)


@dataclass(frozen=True)
class LinearModel:
    """A fitted or given multinomial linear model, applied as plain column expressions.

    It has what the operators here use of Spark's fitted models: `transform`, `numFeatures` and `coefficientMatrix`.
    """

    coefficients: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    @property
    def numFeatures(self) -> int:
        return len(self.coefficients[0])

    @property
    def coefficientMatrix(self):
        return DenseMatrix(
            len(self.coefficients), self.numFeatures, [v for row in self.coefficients for v in row], isTransposed=True
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with rawPrediction, probability and prediction from its column `features`."""
        weights, start = np.array(self.coefficients, float), np.array(self.intercepts, float)

        # Every input of every row in lambdas of Spark is a boxed value; a batch is one numpy column per input.
        @F.arrow_udf("array<double>")
        def logits(x: pa.Array) -> pa.Array:
            inputs = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), weights.shape[1]).T)
            z = np.repeat(start[:, None], len(x), axis=1)
            for values, factors in zip(inputs, weights.T):
                z += values * factors[:, None]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(start), pa.int32()), pa.array(z.T.ravel()))

        out = df.withColumn("_z", logits(vector_to_array("features"))).withColumn("_m", F.array_max("_z"))
        out = out.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.col("_m"))))
        total = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
        return out.withColumns(
            {
                "rawPrediction": array_to_vector("_z"),
                "probability": array_to_vector(F.transform("_e", lambda e: e / total)),
                "prediction": (F.array_position("_z", F.col("_m")) - 1).cast("double"),
            }
        ).drop("_z", "_m", "_e")


@dataclass(frozen=True)
class NextWindowForecaster:
    """Two heads over the same history: dominant state and attack alert of the next window."""

    scaler: MinMaxModel
    state_model: object
    alert_model: object
    features: tuple[str, ...]

    def transform(self, sequences: DataFrame) -> DataFrame:
        vectors = flat_history(sequences, self.scaler, self.features)
        state = with_probabilities(self.state_model.transform(vectors))
        alerts = [f"alert_{c.lower()}" for c in ALERT_CLASSES]
        both = with_probabilities(self.alert_model.transform(state), alerts, ALERT_CLASSES, "alert_pred")
        return both.withColumn("attack_probability", 1.0 - F.col(alerts[0])).drop("features")


def fit_next_window(
    train: DataFrame, train_windows: DataFrame, features: Sequence[str] = STATE_FEATURES, capped: bool = False,
    iterations: int = 100,
) -> NextWindowForecaster:
    """Fit both heads on gap-aware training sequences; the scaler sees training windows only."""
    scaler = fit_min_max(train_windows, features)
    vectors = flat_history(train, scaler, features)
    heads = []
    for label, classes in (("y_dominant_state", STATE_CLASSES), ("y_attack_alert", ALERT_CLASSES)):
        rows = vectors.withColumn("label", encode_label(F.col(label), classes).cast("double")).where(F.col("label").isNotNull())
        rows = with_class_weights(rows, label, classes) if capped else rows
        heads.append(fit_logistic(rows.select("features", "label", *(["weight"] if capped else [])), iterations, "weight" if capped else None))
    return NextWindowForecaster(scaler, heads[0], heads[1], tuple(features))


def select_candidate(scores: Mapping[str, Sequence[float]], preferred: str = "unweighted") -> str:
    """Candidate with the best mean fold score; ties prefer `preferred`."""
    return max(scores, key=lambda name: (float(np.mean(scores[name])), name == preferred))


def fit_multistep(
    train: DataFrame, train_windows: DataFrame, horizons: int = HORIZONS, features: Sequence[str] = STATE_FEATURES,
    iterations: int = 50,
) -> tuple[MinMaxModel, list, list]:
    """One state head and one alert head per horizon over multi-step samples."""
    scaler = fit_min_max(train_windows, features)
    vectors = flat_history(train, scaler, features)
    states, alerts = [], []
    for h in range(horizons):
        for column, classes, models in (("y_dominant", STATE_CLASSES, states), ("y_alert", ALERT_CLASSES, alerts)):
            rows = vectors.select("features", encode_label(F.col(column)[h], classes).cast("double").alias("label"))
            models.append(fit_logistic(rows.where(F.col("label").isNotNull()), iterations))
    return scaler, states, alerts


def predict_multistep(
    samples: DataFrame, fitted: tuple[MinMaxModel, list, list], keep: Sequence[str], features: Sequence[str] = STATE_FEATURES
) -> DataFrame:
    """One row per (sample, horizon): state probabilities, attack probability, and truth where the samples have it."""
    scaler, states, alerts = fitted
    scored = flat_history(samples, scaler, features)
    for h, (state, alert) in enumerate(zip(states, alerts)):
        scored = state.transform(scored).withColumn(f"_s{h}", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
        scored = alert.transform(scored).withColumn(f"_a{h}", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
    truth = F.col("y_dominant") if "y_dominant" in samples.columns else F.lit(None).cast("array<string>")
    table = F.array(*[F.lit(c) for c in STATE_CLASSES])

    def padded(vector: Column, i: int) -> Column:
        return F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0))

    rows = []
    for h in range(len(states)):
        vector = F.col(f"_s{h}")
        best = F.array_position(vector, F.array_max(vector)).cast("int")
        rows.append(
            F.struct(
                F.lit(h + 1).alias("horizon"),
                F.get(truth, F.lit(h)).alias("y_true"),
                F.element_at(table, best).alias("y_pred"),
                *[padded(vector, i).alias(n) for i, n in enumerate(PROBABILITIES)],
                (F.lit(1.0) - padded(F.col(f"_a{h}"), 0)).alias("attack_probability"),
            )
        )
    return scored.select(*keep, F.inline(F.array(*rows)))


@dataclass(frozen=True)
class LagRegression:
    """Next value of every feature from its own history: intercept and one weight per lag."""

    weights: tuple[tuple[float, ...], ...]

    def next_vector(self, history: Column) -> Column:
        """Next feature vector from an array of scaled vectors."""
        values = []
        for j, (intercept, *lags) in enumerate(self.weights):
            total = F.lit(float(intercept))
            for i, weight in enumerate(lags):
                total = total + F.lit(float(weight)) * history[i][j]
            values.append(total)
        return F.array(*values)


def fit_lag_regression(pairs: DataFrame, scaler: MinMaxModel, features: Sequence[str] = STATE_FEATURES, length: int = SEQUENCE_LENGTH, ridge: float = 1e-6) -> LagRegression:
    """Least squares per feature from sums of products: one grouped pass, then one small system per feature."""
    scaled = pairs.select(
        scaler.transform_vectors(F.col("X"), features).alias("x"),
        scaler.transform_vectors(F.array("y_state"), features)[0].alias("y"),
    )
    by_feature = scaled.select(
        F.posexplode("y").alias("feature", "target"), F.col("x")
    ).select("feature", "target", *[F.get(F.col("x")[i], F.col("feature")).alias(f"x{i}") for i in range(length)])
    terms = [F.lit(1.0), *[F.col(f"x{i}") for i in range(length)]]
    sums = [F.sum(terms[a] * terms[b]).alias(f"g{a}_{b}") for a in range(length + 1) for b in range(a, length + 1)]
    sums += [F.sum(terms[a] * F.col("target")).alias(f"b{a}") for a in range(length + 1)]
    rows = {r["feature"]: r for r in by_feature.groupBy("feature").agg(*sums).collect()}
    weights = []
    for j in range(len(features)):
        row, size = rows[j], length + 1
        gram = np.array([[row[f"g{min(a, b)}_{max(a, b)}"] for b in range(size)] for a in range(size)])
        right = np.array([row[f"b{a}"] for a in range(size)])
        weights.append(tuple(float(w) for w in np.linalg.solve(gram + ridge * np.eye(size), right)))
    return LagRegression(tuple(weights))


def rollout(
    histories: DataFrame, scaler: MinMaxModel, state_model, regression: LagRegression, keep: Sequence[str],
    steps: int = ROLLOUT_STEPS, features: Sequence[str] = STATE_FEATURES,
) -> DataFrame:
    """Predict class and next vector, append the predicted vector to the history, repeat.

    Every step is a projection over all histories at once. One row per (history, step).
    """
    if int(steps) < 1:
        raise ValueError("A rollout has at least one step.")
    current = histories.withColumn("_h", scaler.transform_vectors(F.col("X"), features))
    table = F.array(*[F.lit(c) for c in STATE_CLASSES])
    for k in range(steps):
        current = state_model.transform(current.withColumn("features", array_to_vector(F.flatten("_h"))))
        current = current.withColumn(f"_p{k}", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction", "features")
        current = current.withColumn("_n", regression.next_vector(F.col("_h")))
        current = current.withColumn("_h", F.concat(F.slice("_h", 2, F.size("_h") - 1), F.array("_n"))).drop("_n")
    rows = []
    for k in range(steps):
        vector = F.col(f"_p{k}")
        best = F.array_position(vector, F.array_max(vector)).cast("int")
        rows.append(
            F.struct(
                F.lit(k + 1).alias("step"),
                F.element_at(table, best).alias("y_pred"),
                *[F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(PROBABILITIES)],
            )
        )
    out = current.select(*keep, F.inline(F.array(*rows)))
    return out.withColumn("alarm", F.round(1.0 - F.col(PROBABILITIES[0]), 4) >= ALARM_PROBABILITY)


def linear_contributions(vectors: DataFrame, model, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Array `contributions` of (feature, coefficient x input) for the score of the predicted class of every row.

    A vector longer than the feature list is a flattened history; contributions are averaged over its windows. The
    arrays are built row by row, nothing is shuffled.
    """
    scored = model.transform(vectors).withColumns(
        {"_class": F.col("prediction").cast("int"), "_x": vector_to_array("features")}
    )
    coefficients = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in model.coefficientMatrix.toArray()])
    products = F.zip_with("_x", F.get(coefficients, F.col("_class")), lambda x, c: x * c)
    windows = model.numFeatures // len(features)
    entries = []
    for j, name in enumerate(features):
        total = F.get("_v", F.lit(j))
        for w in range(1, windows):
            total = total + F.get("_v", F.lit(w * len(features) + j))
        entries.append(F.struct(F.lit(name).alias("feature"), (total / windows).alias("contribution")))
    return scored.withColumn("_v", products).select(*keep, F.array(*entries).alias("contributions"))


def _by_size(contributions: Column) -> Column:
    """Contributions by falling size, equal sizes by name."""
    keyed = F.transform(
        contributions, lambda c: F.struct((-F.abs(c["contribution"])).alias("s"), c["feature"].alias("f"), c["contribution"].alias("c"))
    )
    return F.transform(F.array_sort(keyed), lambda k: F.struct(k["f"].alias("feature"), k["c"].alias("contribution")))


def ranked_contributions(contributions: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per contribution with its rank and direction."""
    rows = contributions.select(*keep, F.posexplode(_by_size(F.col("contributions"))).alias("_i", "_c"))
    value = F.col("_c.contribution")
    direction = F.when(value >= 0, F.lit("increase")).otherwise(F.lit("decrease"))
    return rows.select(
        *keep, (F.col("_i") + 1).alias("rank"), F.col("_c.feature").alias("feature"), value.alias("contribution"),
        direction.alias("direction"),
    )


def top_features(contributions: DataFrame, keep: Sequence[str], k: int = 8) -> DataFrame:
    """The k largest contributions of every row, rounded."""
    top = F.slice(_by_size(F.col("contributions")), 1, k)
    rows = contributions.select(*keep, F.posexplode(top).alias("_i", "_c"))
    return rows.select(
        *keep, (F.col("_i") + 1).alias("rank"), F.col("_c.feature").alias("feature"),
        F.round("_c.contribution", 6).alias("contribution"),
    )


def driving_features(contributions: DataFrame, k: int = 10) -> DataFrame:
    """Mean absolute and mean signed contribution per feature over all rows, the k largest."""
    grouped = contributions.select(F.inline("contributions")).groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("_abs"),
        F.round(F.avg(F.abs("contribution")), 6).alias("mean_abs_contribution"),
        F.round(F.avg("contribution"), 6).alias("mean_signed_contribution"),
    )
    return grouped.orderBy(F.desc("_abs"), "feature").limit(k).drop("_abs")


def sample_allocation(counts: Mapping[str, int], size: int) -> dict[str, int]:
    """Samples per class of a sample of `size` rows: the floor of its share, one at least, then evened out.

    The samples of a class are numbered from 1. Too many are taken back from the highest numbers; missing ones go where
    most rows are left over; equal cases follow the order of the names. More classes than samples give one sample to each
    of the first `size` names.
    """
    names = sorted(counts)
    total = sum(counts.values())
    target = min(size, total)
    if len(names) > target:
        return {c: int(i < target) for i, c in enumerate(names)}
    shares = {c: max(1, target * counts[c] // total) for c in names}
    missing = target - sum(shares.values())
    if missing < 0:
        numbered = sorted((-n, c) for c in names for n in range(2, shares[c] + 1))
        moved = [(c, -1) for _, c in numbered[:-missing]]
    else:
        spare = sorted((shares[c] + n - counts[c], c) for c in names for n in range(missing))
        moved = [(c, 1) for _, c in spare[:missing]]
    return {c: shares[c] + sum(step for name, step in moved if name == c) for c in names}


def stratified_sample(rows: DataFrame, label: str, row_id: str, size: int = 100, seed: int = SEED) -> DataFrame:
    """About `size` rows with every class represented, chosen by a seeded hash of the row id.

    The rank filter runs before the shuffle, so a class sends at most its allocation per task.
    """
    counted = rows.where(F.col(label).isNotNull()).groupBy(label).count()
    counts = {r[label]: r["count"] for r in counted.collect()}  # one row per class
    share = {c: n for c, n in sample_allocation(counts, size).items() if n}
    if not share:
        return rows.limit(0)
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), F.col(row_id)), row_id)
    wanted = F.coalesce(*[F.when(F.col(label) == c, F.lit(n)) for c, n in share.items()])
    ranked = rows.where(F.col(label).isin(list(share))).withColumn("_rank", F.row_number().over(order))
    ranked = ranked.where(F.col("_rank") <= max(share.values()))
    return ranked.where(F.col("_rank") <= wanted).drop("_rank")


def rows_to_explain(predictions: DataFrame, order: str, benign: str = PROBABILITIES[0]) -> DataFrame:
    """The most attack-like row and the middle benign row."""
    from netstate.scale import with_position

    attack = 1.0 - F.col(benign)
    top = predictions.agg(F.max_by(order, F.struct(attack.alias("a"), (-F.col(order)).alias("o"))).alias(order))
    quiet = with_position(predictions.where(F.col("y_pred") == "BENIGN").select(order), [], order, position="_p", total="_n")
    middle = quiet.where(F.col("_p") == F.floor(F.col("_n") / 2) + 1).select(order)
    return top.withColumn("reason", F.lit("most attack-like")).unionByName(middle.withColumn("reason", F.lit("middle benign")))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
