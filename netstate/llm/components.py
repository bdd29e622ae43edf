"""Connected components of a table of links, without a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.scale import stage

MOST_ROUNDS = 60


def connected_components(links: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the least node that can be reached.

    Alternating star contraction: in a large step every node's greater neighbours are linked to its least neighbour, in
    a small step its lesser ones. Each round keeps one row per link at most; rounds grow with the logarithm of the size.
    Least neighbours come from a grouped minimum, which is combined before the shuffle. More rounds than `most_rounds`
    raise an error.
    """
    links = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = stage(small.where("a <> b").distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
    raise RuntimeError(f"The components are not settled after {most_rounds} rounds.")
