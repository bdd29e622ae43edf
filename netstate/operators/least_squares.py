"""Linear forecasters in closed form: class scores and next values by ridge least squares, and their rollout.

A fit is one grouped sum of products over all rows; the system that is solved has one row per input, whatever the data's size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.functions.values import argmax_label
from netstate.scale import with_next, with_previous

RIDGE = 1e-6


def fit_least_squares(rows: DataFrame, inputs: Sequence[str], targets: Mapping[str, Column], ridge: float = RIDGE) -> dict[str, list[float]]:
    """Coefficients of every target, the intercept first. Rows that lack an input or the target do not count.

    Without a row all coefficients are 0. The intercept is shrunk like the others.
    """
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in inputs]]
    size = len(terms)
    sums = []
    for t, (name, target) in enumerate(targets.items()):
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in inputs], target.isNotNull())
        for a in range(size):
            sums += [F.sum(F.when(complete, terms[a] * terms[b])).alias(f"g{t}_{a}_{b}") for b in range(a, size)]
            sums.append(F.sum(F.when(complete, terms[a] * target.cast("double"))).alias(f"r{t}_{a}"))
    found = rows.agg(*sums).first().asDict()
    value = {k: v or 0.0 for k, v in found.items()}
    out = {}
    for t, name in enumerate(targets):
        gram = np.array([[value[f"g{t}_{min(a, b)}_{max(a, b)}"] for b in range(size)] for a in range(size)])
        right = np.array([value[f"r{t}_{a}"] for a in range(size)])
        out[name] = [float(w) for w in np.linalg.solve(gram + ridge * np.eye(size), right)]
    return out


def linear(coefficients: Sequence[float], inputs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * x for w, x in zip(coefficients[1:], inputs)], F.lit(coefficients[0]))


def with_lags(states: DataFrame, value: str, keys: Sequence[str], order: str = "window_id", carried: Sequence[str] = (), bits: int = 16) -> DataFrame:
    """keys, order, now and before (the value of the window and of the one just before it), next (of the one just after) and the
    next window's `carried` columns; null where the neighbour is not the adjacent window."""
    columns = [order, value, *carried]
    rows = states.select(*keys, order, F.col(value).cast("double").alias(value), *carried)
    rows = with_next(with_previous(rows, keys, order, [order, value], "_p_", bits), keys, order, columns, "_n_", bits)
    back, ahead = F.col(order) - F.col(f"_p_{order}") == 1, F.col(f"_n_{order}") - F.col(order) == 1
    return rows.select(
        *keys, order, F.col(value).alias("now"), F.when(back, F.col(f"_p_{value}")).alias("before"), F.when(ahead, F.col(f"_n_{value}")).alias("next"),
        *[F.when(ahead, F.col(f"_n_{c}")).alias(f"next_{c}") for c in carried],
    )


def class_scores(rows: DataFrame, fitted: Mapping[str, Sequence[float]], inputs: Sequence[str] = ("now", "before")) -> DataFrame:
    """rows with a score per class and the class of the greatest one; ties go to the class listed first."""
    scored = rows.withColumns({f"score_{name.lower()}": linear(w, [F.col(c) for c in inputs]) for name, w in fitted.items()})
    return scored.withColumn("y_pred", argmax_label([F.col(f"score_{name.lower()}") for name in fitted], list(fitted)))


def roll_values(rows: DataFrame, coefficients: Sequence[float], steps: int) -> DataFrame:
    """rows with step and value: the forecast of a value from its last two, put in their place, `steps` times."""
    if int(steps) < 1:
        raise ValueError("A rollout has at least one step.")
    state = F.struct(F.col("now"), F.col("before"), F.array().cast("array<double>").alias("path"))

    def forward(so_far: Column, _: Column) -> Column:
        value = linear(coefficients, [so_far["now"], so_far["before"]])
        return F.struct(value.alias("now"), so_far["now"].alias("before"), F.concat(so_far["path"], F.array(value)).alias("path"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(int(steps))), state, forward, lambda s: s["path"])
    return rows.select("*", F.posexplode(path).alias("_at", "value")).withColumn("step", F.col("_at") + 1).drop("_at")
