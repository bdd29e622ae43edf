"""Ordered and small-side operations that hold up when one key owns a large share of the rows.

A window function with ``partitionBy(session)`` sends a whole session to one task. The helpers here cut each
key's order column into fixed-width buckets first. The order column is unique within its key, so a bucket of width
``2**bits`` never holds more than ``2**bits`` rows; only one summary row per bucket crosses bucket borders.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW_BITS = 20
WINDOW_BITS = 16
SALTS = 64
SMALL_SIDE_ROWS = 100_000
SMALL_SIDE_BYTES = 16 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only on a local master that names none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder before staging tables on a cluster.")
        configured = tempfile.mkdtemp(prefix="netstate-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def compile_in_parts(spark: SparkSession) -> None:
    """Let plans over very many columns run as separate operators.

    The JVM compiles no method of more than 8000 bytes. Spark fuses the operators of a stage into one method, which
    exceeds that where each of them has dozens of expressions, and every row would be interpreted.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to the checkpoint folder, so that several readers share one computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def deal(df: DataFrame, rows: int = 250_000, most: int = 4) -> DataFrame:
    """`df` in partitions of equal numbers of rows: one for each core, more for more than `rows` in each, `most` a core at most.

    Fits of trees send the counts of every open node from each partition, so their number is bounded by the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    waves = -(-df.count() // (rows * cores))
    return df.repartition(cores * max(1, min(most, waves)))


def bucket_of(order: str | Column, bits: int) -> Column:
    """Bucket number of an integer order column."""
    column = F.col(order) if isinstance(order, str) else order
    return F.shiftright(column.cast("long"), bits)


def join_small(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = SMALL_SIDE_ROWS,
    max_bytes: int = SMALL_SIDE_BYTES,
) -> DataFrame:
    """Join a large table to a summary: broadcast below a checked size, salted shuffle join above it.

    `small` has at most one row per key. It is computed and stored once; its rows and bytes (of the row format) decide.
    """
    small = stage(small)
    row_bytes = 8 * (len(small.columns) + 2)
    texts = [f.name for f in small.schema.fields if f.dataType.typeName() == "string"]
    lengths = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c in texts]
    size = small.agg(F.count(F.lit(1)).alias("n"), sum(lengths, F.lit(0)).alias("text")).first()
    if size["n"] <= max_rows and size["n"] * row_bytes + size["text"] <= max_bytes:
        return big.join(F.broadcast(small), list(on), how)
    return salted_join(big, small, on, how)


def bounded_rows(small: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame | None:
    """`small` as local rows when it has at most `max_rows`, else None. At most one row more than that is fetched."""
    rows = small.limit(max_rows + 1).collect()
    return small.sparkSession.createDataFrame(rows, small.schema) if len(rows) <= max_rows else None


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Equi join (inner or left) of a large table with a summary too large to broadcast, safe for keys that own much of `big`.

    Keys with more than 0.1 % of the rows, of which there are fewer than a thousand, are spread over `salts`
    partitions; their rows of `small` are repeated once per salt. All other keys are joined as they are. Rows with a NULL
    key match nothing; they pass by the join and are put back for a left one.
    """
    on = list(on)
    some = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in on])
    keyed = big.where(some)
    counts = stage(keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    heavy = counts.where(F.col("_n") > F.lit(total / 1000)).select(*on, F.lit(True).alias("_hot"))
    hot = F.broadcast(heavy)
    row_salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int")
    spread = keyed.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), row_salt).otherwise(F.lit(0)))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = small.join(hot, on, "left").withColumn("_salt", F.explode(copies))
    joined = spread.drop("_hot").join(repeated.drop("_hot"), [*on, "_salt"], how).drop("_salt")
    return joined.unionByName(big.where(~some), allowMissingColumns=True) if how == "left" else joined


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL; `right` adds its other columns."""
    renamed = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, same).drop(*[f"_right_{i}" for i in range(len(keys))])


def with_position(
    df: DataFrame, keys: Sequence[str], order: str, bits: int = ROW_BITS, position: str = "position",
    total: str | None = None, lead: Sequence[str] = (), ties: Sequence[str] = (),
) -> DataFrame:
    """1-based row number of `order` within `keys`, and optionally the row count of the key.

    Equals ``row_number() over (partition by keys order by lead, order, ties)`` without gathering a key in one task: rows
    are numbered within their bucket and shifted by the number of rows in earlier buckets. A NULL key is a key of its
    own; rows whose `order` is NULL come first and share one bucket. `lead` columns have few values each, such as the
    rank of a session.
    """
    keys, lead = list(keys), list(lead)
    bucketed = df.withColumn("_bucket", bucket_of(order, bits))
    parts = [*keys, *lead, "_bucket"]
    counts = bucketed.groupBy(*parts).agg(F.count(F.lit(1)).alias("_rows"))
    per_key = Window.partitionBy(*keys)
    offsets = counts.select(
        *parts,
        (F.sum("_rows").over(per_key.orderBy(*lead, "_bucket")) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(per_key).alias("_rows_of_key"),
    )
    inside = Window.partitionBy(*parts).orderBy(order, *ties)
    numbered = join_null_safe(bucketed, offsets, parts).withColumn(
        position, (F.row_number().over(inside) + F.col("_before")).cast("long")
    )
    added = [F.col(position)] + ([F.col("_rows_of_key").alias(total)] if total else [])
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], *added)


def with_next(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], prefix: str = "next_",
    bits: int = ROW_BITS, lead: Sequence[str] = (),
) -> DataFrame:
    """Columns of the following row of the key, as ``lead`` would give them. Keys, NULLs and `lead`: see `with_position`."""
    return _with_neighbour(df, keys, order, columns, prefix, bits, list(lead), forward=True)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], prefix: str = "prev_",
    bits: int = ROW_BITS, lead: Sequence[str] = (),
) -> DataFrame:
    """Columns of the preceding row of the key, as ``lag`` would give them. Keys, NULLs and `lead`: see `with_position`."""
    return _with_neighbour(df, keys, order, columns, prefix, bits, list(lead), forward=False)


def _with_neighbour(df, keys, order, columns, prefix, bits, lead, forward):
    parts = [*keys, *lead, "_bucket"]
    payload = F.struct(*[F.col(c) for c in columns])
    step = F.lead if forward else F.lag
    border = F.min_by if forward else F.max_by
    bucketed = df.withColumn("_bucket", bucket_of(order, bits))
    # A NULL order stands before every value, as it does in the window.
    place = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)).cast("long"))
    borders = bucketed.groupBy(*parts).agg(border(payload, place).alias("_edge"))
    borders = borders.withColumn("_edge", step("_edge").over(Window.partitionBy(*keys).orderBy(*lead, "_bucket")))
    inside = Window.partitionBy(*parts).orderBy(order)
    joined = join_null_safe(bucketed, borders, parts).withColumn(
        "_neighbour", F.coalesce(step(payload).over(inside), F.col("_edge"))
    )
    added = [F.col(f"_neighbour.{c}").alias(f"{prefix}{c}") for c in columns]
    return joined.select(*[F.col(c) for c in df.columns], *added)


def with_running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, bits: int = ROW_BITS
) -> DataFrame:
    """Running sum of `value` in `order` within `keys`, current row included."""
    keys = list(keys)
    bucketed = df.withColumn("_bucket", bucket_of(order, bits))
    sums = bucketed.groupBy(*keys, "_bucket").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    offsets = sums.withColumn(
        "_before", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_sum")
    ).drop("_sum")
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        join_null_safe(bucketed, offsets, [*keys, "_bucket"])
        .withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def with_halo(
    df: DataFrame, order: str, before: int, after: int, bits: int = WINDOW_BITS, chunk: str = "_chunk",
    owned: str = "_owned",
) -> DataFrame:
    """Cut rows into chunks of ``2**bits`` order values and repeat border rows in the neighbouring chunk.

    A row that needs the `before` preceding and `after` following order values finds all of them in the chunk that
    owns it, so frames can be built with ``partitionBy(keys, chunk)``. Keep rows where `owned` is true afterwards.
    """
    size = 1 << bits
    if size < before + after:
        raise ValueError("A chunk must be longer than the frame it serves.")
    home = bucket_of(order, bits)
    inside = F.col(order).cast("long") - F.shiftleft(home, bits)
    chunks = F.array_compact(
        F.array(
            home,
            F.when(inside < F.lit(after), home - 1),
            F.when(inside >= F.lit(size - before), home + 1),
        )
    )
    exploded = df.withColumn("_home", home).withColumn(chunk, F.explode(chunks))
    return exploded.withColumn(owned, F.col(chunk) == F.col("_home")).drop("_home")
