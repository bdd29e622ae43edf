"""Closed-form forecasters against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netstate.operators import least_squares as ls


def test_fit_equals_numpy_and_leaves_incomplete_rows_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 2 + x @ [3, -1] + rng.normal(size=200) / 10
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 5.0), (1.0, None, 5.0), (1.0, 1.0, None)]
    table = spark.createDataFrame(rows, "a double, b double, y double")
    got = ls.fit_least_squares(table, ["a", "b"], {"y": F.col("y"), "high": F.when(F.col("y").isNotNull(), (F.col("y") > 2).cast("int"))}, ridge=0.5)
    full = np.column_stack([np.ones(200), x])
    for name, target in (("y", y), ("high", (y > 2).astype(float))):
        assert np.allclose(got[name], np.linalg.solve(full.T @ full + 0.5 * np.eye(3), full.T @ target))
    assert ls.fit_least_squares(table.limit(0), ["a", "b"], {"y": F.col("y")})["y"] == [0.0, 0.0, 0.0]


def test_lags_are_those_of_adjacent_windows(spark):
    rows = [("s", w, float(10 * w), f"c{w}") for w in (0, 1, 2, 4, 5)] + [("t", 3, 7.0, "x")]
    table = spark.createDataFrame(rows, "session_id string, window_id long, v double, state string")
    got = {(r.session_id, r.window_id): (r.now, r.before, r.next, r.next_state) for r in ls.with_lags(table, "v", ["session_id"], carried=["state"], bits=1).collect()}
    assert got["s", 1] == (10.0, 0.0, 20.0, "c2") and got["s", 2] == (20.0, 10.0, None, None)
    assert got["s", 4] == (40.0, None, 50.0, "c5") and got["t", 3] == (7.0, None, None, None)


def test_rollout_feeds_its_forecasts_back(spark):
    rows = spark.createDataFrame([(1, 3.0, 2.0)], "id int, now double, before double")
    values = [r.value for r in ls.roll_values(rows, [1.0, 0.5, 0.25], 4).orderBy("step").collect()]
    now, before, expected = 3.0, 2.0, []
    for _ in range(4):
        now, before = 1.0 + 0.5 * now + 0.25 * before, now
        expected.append(now)
    assert values == expected
    with pytest.raises(ValueError):
        ls.roll_values(rows, [0.0, 0.0, 0.0], 0)


def test_scores_choose_the_first_of_equal_classes(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (0.0, 5.0)], "now double, before double")
    out = ls.class_scores(rows, {"B": [0.0, 1.0, 0.0], "A": [0.0, 1.0, 0.0], "C": [-2.0, 0.0, 1.0]}).collect()
    assert [r.y_pred for r in out] == ["B", "C"]
