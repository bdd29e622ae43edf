"""Registered queries: linear forecasters fitted in closed form, their scores and their rollout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.catalog.shaping import HOUR
from netstate.catalog.sql import FLOWS, states, with_ctes
from netstate.constants import STATE_CLASSES
from netstate.operators import least_squares as ls
from netstate.operators.states import window_states
from netstate.scale import stage
from netstate.sources.tables import derive_flows

QUERIES = {}
ORACLE = {}
KEYS = ["session_id"]
#: The last session is held out.
TRAIN = "session_id <> 's4'"
STEPS = 6

LAGS = """lags AS (SELECT session_id, window_id, flow_count AS now, CASE WHEN window_id - lag(window_id) OVER o = 1 THEN lag(flow_count) OVER o END AS before,
  CASE WHEN lead(window_id) OVER o - window_id = 1 THEN lead(flow_count) OVER o END AS next, CASE WHEN lead(window_id) OVER o - window_id = 1 THEN lead(dominant_state) OVER o END AS next_state
  FROM states WINDOW o AS (PARTITION BY session_id ORDER BY window_id))"""
_TARGETS = ", ".join(f"('{c}')" for c in STATE_CLASSES) + ", ('flow_count')"
FIT = f"""t AS (SELECT c.target, now, before, CASE WHEN c.target = 'flow_count' THEN next WHEN next_state IS NOT NULL THEN CAST(next_state = c.target AS INT) END AS y
  FROM lags, (VALUES {_TARGETS}) c(target) WHERE {TRAIN}),
g AS (SELECT target, count(*) + {ls.RIDGE} AS g00, sum(now) AS g01, sum(before) AS g02, sum(now * now) + {ls.RIDGE} AS g11, sum(now * before) AS g12, sum(before * before) + {ls.RIDGE} AS g22,
  CAST(sum(y) AS DOUBLE) AS b0, CAST(sum(y * now) AS DOUBLE) AS b1, CAST(sum(y * before) AS DOUBLE) AS b2 FROM t WHERE y IS NOT NULL AND before IS NOT NULL GROUP BY target),
d AS (SELECT *, g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02) AS det FROM g),
fit AS (SELECT target, (b0 * (g11 * g22 - g12 * g12) - g01 * (b1 * g22 - g12 * b2) + g02 * (b1 * g12 - g11 * b2)) / det AS w0,
  (g00 * (b1 * g22 - g12 * b2) - b0 * (g01 * g22 - g12 * g02) + g02 * (g01 * b2 - b1 * g02)) / det AS w1,
  (g00 * (g11 * b2 - b1 * g12) - g01 * (g01 * b2 - b1 * g02) + b0 * (g01 * g12 - g11 * g02)) / det AS w2 FROM d)"""


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _lags(spark: SparkSession, d: str) -> DataFrame:
    return stage(ls.with_lags(window_states(derive_flows(spark, d), HOUR), "flow_count", KEYS, carried=["dominant_state"], bits=8))


def _fitted(lags: DataFrame) -> dict[str, list[float]]:
    following = F.col("next_dominant_state")
    targets = {c: F.when(following.isNotNull(), (following == c).cast("int")) for c in STATE_CLASSES} | {"flow_count": F.col("next")}
    return ls.fit_least_squares(lags.where(TRAIN), ["now", "before"], targets)


@query(with_ctes(FLOWS, states(), LAGS, FIT) + "SELECT target, round(w0, 6) AS intercept, round(w1, 6) AS now, round(w2, 6) AS before FROM fit")
def least_squares_fit(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of the class scores and of the next flow count over the last two windows."""
    rows = [(name, *map(float, w)) for name, w in _fitted(_lags(spark, d)).items()]
    frame = spark.createDataFrame(rows, "target string, intercept double, now double, before double")
    return frame.select("target", *[F.round(c, 6).alias(c) for c in ("intercept", "now", "before")])


_SCORES = ", ".join(f"max(CASE WHEN target = '{c}' THEN w0 + w1 * now + w2 * before END) AS s{i}" for i, c in enumerate(STATE_CLASSES))
_BEST = "greatest(" + ", ".join(f"s{i}" for i in range(len(STATE_CLASSES))) + ")"


@query(
    with_ctes(FLOWS, states(), LAGS, FIT, f"sc AS (SELECT session_id, window_id, next_state, {_SCORES} FROM lags, fit WHERE before IS NOT NULL AND NOT ({TRAIN}) GROUP BY ALL)")
    + f"SELECT session_id, window_id, next_state AS y_true, CASE {_BEST} " + " ".join(f"WHEN s{i} THEN '{c}'" for i, c in enumerate(STATE_CLASSES))
    + " END AS y_pred, " + ", ".join(f"round(s{i}, 5) AS score_{c.lower()}" for i, c in enumerate(STATE_CLASSES)) + " FROM sc"
)
def least_squares_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Scores and class of the window after each window of the held-out session."""
    lags = _lags(spark, d)
    fitted = {c: w for c, w in _fitted(lags).items() if c in STATE_CLASSES}
    scored = ls.class_scores(lags.where(f"before IS NOT NULL AND NOT ({TRAIN})"), fitted)
    return scored.select(
        "session_id", "window_id", F.col("next_dominant_state").alias("y_true"), "y_pred", *[F.round(f"score_{c.lower()}", 5).alias(f"score_{c.lower()}") for c in STATE_CLASSES]
    )


@query(
    "WITH RECURSIVE " + with_ctes(FLOWS, states(), LAGS, FIT)[5:]
    + f""", roll AS (SELECT session_id, window_id, 0 AS step, now AS value, before AS last FROM lags WHERE before IS NOT NULL
  UNION ALL SELECT session_id, window_id, step + 1, w0 + w1 * value + w2 * last, value FROM roll, fit WHERE target = 'flow_count' AND step < {STEPS})
SELECT session_id, window_id, CAST(step AS INT) AS step, round(value, 4) AS value FROM roll WHERE step > 0"""
)
def least_squares_rollout(spark: SparkSession, d: str) -> DataFrame:
    """Flow counts six windows ahead of every window, each step from the forecasts before it."""
    lags = _lags(spark, d)
    rolled = ls.roll_values(lags.where("before IS NOT NULL"), _fitted(lags)["flow_count"], STEPS)
    return rolled.select("session_id", "window_id", F.col("step").cast("int").alias("step"), F.round("value", 4).alias("value"))
