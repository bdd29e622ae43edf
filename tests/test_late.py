"""Late rows and endpoint sketches."""

from datetime import timedelta

from pyspark.sql import functions as F

from netstate.streaming import late
from netstate.streaming.flows import write_available
from tests.helpers import START


def stream_of(spark, path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_every_row_is_accepted_late_or_a_duplicate(spark, tmp_path):
    at = lambda seconds: START + timedelta(seconds=seconds)
    batches = [
        [(1, at(0)), (1, at(0)), (2, at(100)), (None, at(50))],
        [(2, at(100)), (3, at(40)), (4, at(41)), (None, at(60)), (5, None)],
        [(4, at(41)), (6, at(500))],
        [(6, at(500)), (7, at(200))],
    ]
    live = stream_of(spark, str(tmp_path / "in"), "k long, timestamp timestamp", batches)
    folder = str(tmp_path / "out")
    late.sort_out(live, ["k"], folder, str(tmp_path / "checkpoint"), delay_seconds=60).awaitTermination()
    keys = lambda name: sorted(r.k if r.k is not None else -1 for r in spark.read.parquet(f"{folder}/{name}").collect())
    assert keys("accepted") == [-1, 1, 2, 4, 6]
    assert keys("late") == [3, 5, 7]
    assert keys("duplicate") == [-1, 1, 2, 4, 6]
    assert sum(r.rows for r in late.sorted_counts(spark, folder).collect()) == sum(map(len, batches))


def test_sketches_stay_within_their_error_and_merge(spark, tmp_path):
    """A flood of 60,000 sources in two sessions, half of which share addresses."""
    flows = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("session_id"),
        (F.lit(START).cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, id % 7000)")).alias("timestamp"),
        F.concat(F.lit("ip"), F.when(F.col("id") % 4 < 2, F.col("id") - F.col("id") % 2).otherwise(F.col("id"))).alias("src_ip"),
        F.lit("victim").alias("dst_ip"), (F.col("id") % 50_000).cast("int").alias("src_port"), F.lit(80).alias("dst_port"),
    ).unionByName(spark.sql("select 'a' as session_id, timestamp'2030-01-01' as timestamp, null as src_ip, null as dst_ip, 1 as src_port, 1 as dst_port"))
    flows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(flows.schema).parquet(str(tmp_path / "in"))
    write_available(late.endpoint_sketch_stream(live, 3600), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    sketches = spark.read.parquet(str(tmp_path / "out"))
    assert sketches.count() == 4 and sketches.agg(F.max(F.octet_length("src_ip"))).first()[0] < 5000
    whole = late.merged_endpoints(sketches, []).first()
    true = flows.agg(F.count_distinct("src_ip")).first()[0]
    assert abs(whole.unique_src_ip_count - true) < 0.05 * true and whole.unique_dst_ip_count == 1
    assert abs(whole.unique_src_port_count - 50_000) < 2500
    by_session = {r.session_id: r.unique_src_ip_count for r in late.merged_endpoints(sketches, ["session_id"]).collect()}
    for session, n in by_session.items():
        own = flows.where(F.col("session_id") == session).agg(F.count_distinct("src_ip")).first()[0]
        assert abs(n - own) < 0.05 * own
