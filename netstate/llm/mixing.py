"""Mixing sources to target weights: exact quotas, a splitting tree over output shards, disjoint blocks, local shuffles.

Sizes are words. A source's texts stand in a random order and are cut into blocks of about equal words. Its quota of
blocks follows from its target: whole passes over the source and a part of one, whose blocks are cut from the texts chosen
for it. A multivariate-hypergeometric tree halves the shards again and again and deals each half its exact number of blocks,
drawn from all sources without replacement. A shard then owns a range of each source's permuted blocks, and every copy of a
text lies in one of them; a shard's rows are shuffled by a random key.

A running sum over a source goes through buckets of the random order, so that no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netstate.llm import text as T
from netstate.scale import join_small, stage

WEIGHTS = (1.0, 2.0, 3.0)
MOST_TIMES = 3
SHARDS = 16
BLOCKS_PER_SHARD = 2048
BUCKETS = 4096
FILL_ROUNDS = 3


def n_words(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    column = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.coalesce(column, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.size(words).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST_TIMES) -> np.ndarray:
    """Shares of all sizes by weight, none above `most` times its size; what is cut off goes to the others by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, rest, open_ = np.zeros(len(sizes)), sizes.sum(), np.ones(len(sizes), bool)
    while open_.any() and rest > 0:
        share = rest * weights / weights[open_].sum()
        full = open_ & (share >= most * sizes)
        if not full.any():
            out[open_] = share[open_]
            break
        out[full] = most * sizes[full]
        rest -= out[full].sum()
        open_ &= ~full
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source in each shard, (sources, shards): exact in both sums, shards within one block of equal."""
    if shards == 1:
        return quotas[:, None]
    left = shards // 2
    total = int(quotas.sum())
    wanted = sum(total // shards + (i < total % shards) for i in range(left))
    first = rng.multivariate_hypergeometric(quotas, wanted, method="marginals") if total else quotas * 0
    return np.concatenate([split_tree(first, left, rng), split_tree(quotas - first, shards - left, rng)], 1)


def plan_sources(sizes: DataFrame, weights: Sequence[float], most: int, shards: int, seed: int) -> DataFrame:
    """From one row per source (src, source, source_size): target, passes, words of the part pass, block size, shard bounds.

    This is one small task: its input is a row per source, whatever the size of the sources. It holds about 300 bytes of each,
    so tables with up to some millions of sources are meant.
    """

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("src", key=lambda s: s.map(lambda v: (v == "", v.encode()))).reset_index(drop=True)
        size = frame["source_size"].to_numpy(np.int64)
        target = targets(size, np.array([weights[i % len(weights)] for i in range(len(size))]), most)
        passes = np.minimum(most, np.floor(target / np.maximum(size, 1) + 1e-12)).astype(np.int64)
        part = np.where(passes < most, np.maximum(0, np.rint(target - passes * size)), 0).astype(np.int64)
        block = max(1, int(size.sum()) // (shards * BLOCKS_PER_SHARD))
        blocks = -(-size // block)
        quotas = passes * blocks + -(-part // block)
        dealt = split_tree(quotas, shards, np.random.default_rng(seed))
        bounds = np.cumsum(dealt, 1)
        return frame.assign(
            target=target, passes=passes, part=part, block_words=block, blocks=blocks, bounds=[b.tolist() for b in bounds]
        )

    schema = (
        "src string, source_size long, target double, passes long, part long, block_words long, blocks long, bounds array<long>"
    )
    return sizes.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda f: plan(f.drop(columns="_one")), schema)


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Sum of `value` over the rows of the same src before this one, in the order of the column `draw`."""
    valued = rows.withColumn("_value", value).withColumn("_bucket", F.floor(F.col("draw") * BUCKETS).cast("int"))
    sums = valued.groupBy("src", "_bucket").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("src").orderBy("_bucket")) - F.col("_sum")
    sums = sums.select("src", "_bucket", before.alias("_offset"))
    order = Window.partitionBy("src", "_bucket").orderBy("draw", "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = valued.join(sums, ["src", "_bucket"])
    return joined.withColumn(name, F.sum("_value").over(order) - F.col("_value") + F.col("_offset")).drop("_value", "_bucket", "_offset")


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
    most: int = MOST_TIMES, shards: int = SHARDS, seed: int = 13,
) -> DataFrame:
    """Decisions for every distinct (key, text, source): size, source_size, target, copies, taken, and how often the row occurs;
    shards and blocks list the shard of each copy and the block of its source's quota that it lies in.

    Sources stand in the order of their code points, null last, and take the weights in turn. Rows equal in key, text and
    source (`rows` of them) are taken or left together. A text without words, null or empty, has size 0; a source without
    words has target 0, and its texts are left. An empty table gives no rows. The result depends on the rows and the seed only. Other columns are not read.
    """
    unit = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    wanted = docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("src"),
        n_words(text).alias("size"), unit.alias("unit"),
    )
    units = wanted.groupBy("id", "source", "src", "unit").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    units = stage(units.withColumn("draw", T.unit_hash("unit", "src", seed=seed)))
    sizes = units.groupBy("src").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    plan = plan_sources(sizes, weights, most, shards, seed)
    words = F.col("size") * F.col("rows")
    placed = join_small(running(units, words, "before"), plan, ["src"], "inner")
    # at: where a text of the part pass begins among those chosen for it.
    in_part = (F.col("part") > 0) & (F.col("before") + words <= F.col("part"))
    placed = stage(placed.withColumn("at", F.when(in_part, F.col("before"))))
    chosen = F.col("at").isNotNull()
    for _ in range(FILL_ROUNDS):  # what the part pass leaves open is filled with other texts that fit, the first ones in order
        left = placed.groupBy("src").agg((F.first("part") - F.sum(F.when(chosen, words).otherwise(0))).alias("open"))
        fits = ~chosen & (F.col("part") > 0) & (words <= F.col("open"))
        fitting = join_small(placed, left, ["src"], "inner").withColumn("fits", fits)
        filled = running(fitting, F.when(F.col("fits"), words).otherwise(F.lit(0)), "used")
        filler = F.when(F.col("fits") & (F.col("used") + words <= F.col("open")), F.col("part") - F.col("open") + F.col("used"))
        placed = stage(filled.withColumn("at", F.coalesce("at", filler)).drop("open", "fits", "used"))
    copies = F.col("passes") + chosen.cast("long")

    def block(first: str, blocks: Column) -> Column:
        return F.least(F.floor((F.col(first) + words / 2) / F.col("block_words")), blocks - 1)

    whole, part = F.col("blocks"), F.ceil(F.col("part") / F.col("block_words"))
    numbers = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(F.array().cast("array<bigint>"))
    dealt = F.transform(numbers, lambda number: number * whole + block("before", whole))
    last = F.when(chosen, F.array(F.col("passes") * whole + block("at", part))).otherwise(F.array().cast("array<bigint>"))
    shard = lambda index: F.size(F.filter("bounds", lambda b: b <= index))
    return placed.withColumn("copies", copies).withColumn("dealt", F.concat(dealt, last)).select(
        F.col("id").alias(key), F.col("source").alias(source), "unit", "rows", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), F.transform("dealt", shard).alias("shards"), F.col("dealt").alias("blocks"),
    )


def draw_mix(docs: DataFrame, decisions: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             seed: int = 13) -> DataFrame:
    """The mixed rows: those of docs, once per copy, with shard and shuffle_key; each shard is sorted by the latter.

    Columns of docs named shard or shuffle_key are replaced; others may have any name.
    """
    docs = docs.drop("shard", "shuffle_key")
    unit, copy = "_unit", "_copy"
    while unit in docs.columns or copy in docs.columns:
        unit, copy = unit + "_", copy + "_"
    chosen = decisions.where("copies > 0").select(
        F.col(key).alias("_k"), F.col(source).alias("_s"), F.col("unit").alias("_u"), "shards"
    ).alias("m")
    own = docs.withColumn(unit, F.xxhash64(F.lit(seed), F.col(key), F.col(text))).alias("d")
    same = (F.col(f"d.{unit}") == F.col("m._u")) & F.col(f"d.`{key}`").eqNullSafe(F.col("m._k")) & F.col(f"d.`{source}`").eqNullSafe(F.col("m._s"))
    joined = own.join(chosen, same).select(*[F.col(f"d.`{c}`") for c in docs.columns], f"d.{unit}", F.posexplode("m.shards").alias(copy, "shard"))
    keyed = joined.withColumn("shuffle_key", F.xxhash64(F.lit(seed), unit, copy)).drop(unit, copy)
    pieces = F.pmod(F.shiftright("shuffle_key", 40), F.lit(8))  # a shard's rows in several tasks, each a range of its order
    return keyed.repartition("shard", pieces).sortWithinPartitions("shard", "shuffle_key")
