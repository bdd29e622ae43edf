from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from netstate import scale

rows_strategy = st.lists(st.tuples(st.sampled_from("ab"), st.integers(-50, 400)), min_size=1, max_size=40, unique=True)
quick = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame([(k, o, o * 3 % 7) for k, o in rows], "k string, o long, v long")


@quick
@given(rows=rows_strategy)
def test_position_equals_row_number(spark, rows):
    df = frame(spark, rows)
    got = scale.with_position(df, ["k"], "o", bits=3, position="p", total="n")
    w = Window.partitionBy("k")
    want = df.withColumn("p", F.row_number().over(w.orderBy("o")).cast("long")).withColumn("n", F.count("*").over(w))
    assert sorted(got.collect()) == sorted(want.collect())


@quick
@given(rows=rows_strategy)
def test_neighbours_and_running_total_equal_windows(spark, rows):
    df = frame(spark, rows)
    w = Window.partitionBy("k").orderBy("o")
    key = lambda r: tuple(-999 if v is None else v for v in r)
    nxt = scale.with_next(df, ["k"], "o", ["o", "v"], "n_", bits=3)
    want = df.withColumn("n_o", F.lead("o").over(w)).withColumn("n_v", F.lead("v").over(w))
    assert sorted(map(key, nxt.collect())) == sorted(map(key, want.collect()))
    prev = scale.with_previous(df, ["k"], "o", ["v"], "p_", bits=3)
    want = df.withColumn("p_v", F.lag("v").over(w))
    assert sorted(map(key, prev.collect())) == sorted(map(key, want.collect()))
    total = scale.with_running_total(df, ["k"], "o", "v", "t", bits=3)
    want = df.withColumn("t", F.sum("v").over(w))
    assert sorted(total.collect()) == sorted(want.collect())


def test_join_small_agrees_below_and_above_the_bound(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k long, t string")
    broadcast = scale.join_small(big, small, ["k"])
    salted = scale.join_small(big, small, ["k"], max_rows=1)
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()
    assert sorted(broadcast.select("k", "id", F.coalesce("t", F.lit(""))).collect()) == sorted(
        salted.select("k", "id", F.coalesce("t", F.lit(""))).collect()
    )


def test_salted_join_keeps_every_row_of_hot_and_rare_keys(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(-1, 2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        got = scale.salted_join(big, small, ["k"], how, salts=4)
        want = big.join(small, ["k"], how)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_halo_repeats_only_border_rows(spark):
    df = spark.range(0, 32).withColumnRenamed("id", "o")
    chunked = scale.with_halo(df, "o", 2, 1, bits=3)
    assert chunked.where("_owned").count() == 32
    assert chunked.count() == 32 + 4 * 3


def test_session_names_the_checkpoint_folder(spark):
    assert scale.ensure_checkpoint_dir(spark).rstrip("/").find(spark.conf.get("spark.checkpoint.dir").rstrip("/")) >= 0
