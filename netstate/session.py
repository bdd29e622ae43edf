"""Session settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "netstate", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Staged tables go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Plans consist of many small expressions; a Python call site for each one doubles the time to build them.
        "spark.sql.dataFrameQueryContext.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Row-order windows gather sets of at most ten values each; hash aggregation holds many such groups.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    }
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
