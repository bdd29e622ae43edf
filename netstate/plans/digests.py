"""Identity digests: sample lists and configuration keys."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.scale import WINDOW_BITS, bucket_of

#: With buckets of 2**16, four levels cover every 64-bit order.
LEVELS = 4


def sample_digest(
    samples: DataFrame, sample_id: str, order: str, keys: Sequence[str], bits: int = WINDOW_BITS
) -> DataFrame:
    """Order-sensitive sha-256 of the sample ids of each key, as the root of a tree of digests.

    Ids are digested per bucket of 2**bits values of `order`, buckets per 2**bits buckets, and so on for LEVELS levels, so
    that no task holds more than one bucket of ids or of digests.
    """
    entry = F.struct(F.col(order).alias("o"), F.col(sample_id).cast("string").alias("s"))
    joined = lambda items: F.sha2(F.array_join(F.transform(items, lambda e: e["s"]), "\n"), 256)
    level = samples.groupBy(*keys, bucket_of(order, bits).alias("o")).agg(
        F.count(F.lit(1)).alias("n"), joined(F.array_sort(F.collect_list(entry))).alias("s")
    )
    for _ in range(LEVELS - 2):
        level = level.groupBy(*keys, F.shiftright("o", bits).alias("_up")).agg(
            F.sum("n").alias("n"), joined(F.array_sort(F.collect_list(F.struct("o", "s")))).alias("s")
        ).withColumnRenamed("_up", "o")
    return level.groupBy(*keys).agg(
        F.sum("n").alias("samples"), joined(F.array_sort(F.collect_list(F.struct("o", "s")))).alias("digest")
    )


def identity_key(identity: Mapping) -> str:
    """sha-256 of a configuration with sorted keys; equal configurations share a cache entry."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
