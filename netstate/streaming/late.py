"""Rows behind the watermark as a table of their own, and distinct endpoints of windows as mergeable sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENDPOINTS = ("src_ip", "dst_ip", "src_port", "dst_port")
#: Sketches of 2**12 registers: a standard error of 1.6 %, a few kilobytes each however many endpoints there are.
SKETCH_BITS = 12


def _stored(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """Batches before a number of a table that a sink wrote; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(folder).where(F.col("batch") < before).drop("batch")


def sort_out(flows: DataFrame, keys: Sequence[str], folder: str, checkpoint: str, timestamp: str = "timestamp", delay_seconds: int = 600):
    """Start a query that writes every row of a stream to one of three tables of `folder`: accepted, late or duplicate.

    The mark is the greatest time of all earlier batches less the delay. A row at or behind the mark is late, also if it is a
    duplicate; of the others, the first with its keys is accepted and the rest are duplicates, in the same batch or a later
    one. A row without time is late. Only accepted rows ahead of the mark are compared with. A batch that runs again writes the
    same rows to the same place.
    """
    keys = list(keys)

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = _stored(spark, f"{folder}/mark", number)
        mark = None if marks is None else marks.agg(F.max("greatest")).first()[0]
        behind = F.col(timestamp).isNull() if mark is None else F.col(timestamp).isNull() | (F.col(timestamp) <= F.lit(mark) - F.expr(f"interval {delay_seconds} seconds"))
        rows = batch.withColumn("_row", F.monotonically_increasing_id()).persist()
        try:
            ahead = rows.where(~behind)
            chosen = ahead.groupBy(*keys).agg(F.min_by("_row", F.struct(F.col(timestamp), F.col("_row"))).alias("_row"))
            before = _stored(spark, f"{folder}/accepted", number)
            if before is not None:
                known = before.where(F.col(timestamp) > F.lit(mark) - F.expr(f"interval {delay_seconds} seconds")) if mark is not None else before
                same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
                chosen = chosen.alias("n").join(known.select(*keys).alias("o"), same, "left_anti")
            chosen = chosen.select("_row")
            tables = {
                "late": rows.where(behind), "accepted": ahead.join(chosen, "_row", "left_semi"), "duplicate": ahead.join(chosen, "_row", "left_anti"),
                "mark": rows.agg(F.max(timestamp).alias("greatest")).where("greatest is not null"),
            }
            for name, table in tables.items():
                table.drop("_row").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            rows.unpersist()

    return flows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sorted_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows a `sort_out` query has put in each table."""
    counts = None
    for name in ("accepted", "late", "duplicate"):
        one = spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("kind"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def endpoint_sketch_stream(
    flows: DataFrame, window_seconds: int, delay: str = "1 minute", timestamp: str = "timestamp", endpoints: Sequence[str] = ENDPOINTS,
    bits: int = SKETCH_BITS,
) -> DataFrame:
    """A sketch of the distinct values of every endpoint column per session and window of a stream; nulls do not count.

    The state of a window has one sketch per column, so it does not grow with the sources of a flood.
    """
    counted = flows.withWatermark(timestamp, delay).groupBy("session_id", F.window(timestamp, f"{window_seconds} seconds").alias("_w"))
    return counted.agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits)).alias(c) for c in endpoints]).select(
        "session_id", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *endpoints
    )


def merged_endpoints(sketches: DataFrame, by: Sequence[str | Column], endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """Distinct endpoints of any union of windows and sessions, from their sketches."""
    merged = sketches.groupBy(*by).agg(*[F.hll_union_agg(c).alias(c) for c in endpoints])
    keys = [c for c in merged.columns if c not in endpoints]
    return merged.select(*keys, *[F.hll_sketch_estimate(c).alias(f"unique_{c}_count") for c in endpoints])
