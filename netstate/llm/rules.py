"""Quality rules whose cutoffs adapt to each language and source.

Per text, signals are counted. Mergeable quantile sketches of each signal are built per language and source, merged into
one per language and one for all, and turned into cutoffs: the upper quartile plus a multiple of the quartile distance.
A group with few texts takes the cutoffs of its language, and a language with few texts those of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.llm import text as T

SIGNALS = ["symbol_share", "dup_line_share", "repeat_share", "long_word_excess"]
#: Accuracy of the sketches (items they hold at a level) and the least number of texts for cutoffs of one's own.
SKETCH_SIZE = 1024
LEAST_TEXTS = 200
#: Quartile distances above the upper quartile, and the least distance for a signal that hardly varies.
FENCE = 6.0
LEAST_FENCE = {"symbol_share": 0.02, "dup_line_share": 0.3, "repeat_share": 0.3, "long_word_excess": 6.0}

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(values: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    same = np.zeros(len(values), bool)
    equal = ordered[1:] == ordered[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    out = np.empty(len(values), bool)
    out[order] = same
    return out


def count_run(data: np.ndarray, borders: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of each text of a run."""
    n = len(borders) - 1
    starts, ends, owner = T.spans(data, borders, T.NOT_SPACE)
    words = T.span_hashes(data, starts, ends)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    counts = {"n_words": np.bincount(owner, minlength=n), "word_chars": np.bincount(owner, heads[ends] - heads[starts], n)}
    signs = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOL[data], out=signs[1:])
    counts["n_symbols"] = signs[borders[1:]] - signs[borders[:-1]]
    # Lines: every text has one more than it has line feeds.
    feeds = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([borders[:-1], feeds + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([borders[1:], feeds]), kind="stable")
    holds = np.searchsorted(starts, line_ends, "left") > np.searchsorted(starts, line_starts, "left")
    line_starts, line_ends = line_starts[holds], line_ends[holds]
    line_owner = np.searchsorted(borders, line_starts, "right") - 1
    salted = T.pair(T.span_hashes(data, line_starts, line_ends), line_owner.astype(np.uint64))
    _, first = np.unique(salted, return_index=True)
    later = np.ones(len(salted), bool)
    later[first] = False
    counts["n_dup_lines"] = np.bincount(line_owner[later], minlength=n)
    counts["n_lines"] = np.bincount(line_owner, minlength=n)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        inside = owner[2:] == owner[:-2]
        window = T.pair(T.pair(T.pair(words[:-2], words[1:-1]), words[2:]), owner[2:].astype(np.uint64))
        at = np.flatnonzero(inside)
        at = at[_repeated(window[at])]
        for k in range(3):
            covered[at + k] = True
    counts["n_repeat_words"] = np.bincount(owner, covered, n)
    return {k: v.astype(np.int64) for k, v in counts.items()}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def count_signals(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """key, the grouping columns as group_1 and group_2, the five counts and n_lines of every row; a null text has none of anything."""
    kinds = ", ".join(
        f"{name} {docs.schema[c].dataType.simpleString()}" for name, c in ((f"`{key}`", key), ("group_1", groups[0]), ("group_2", groups[1]))
    )
    names = [*COUNTS, "n_lines"]
    wanted = docs.select(F.col(key), F.col(groups[0]).alias("group_1"), F.col(groups[1]).alias("group_2"), F.col(text).alias("t"))

    def count(batches):
        for batch in batches:
            parts = [count_run(data, borders) for _, data, borders in T.runs(batch.column("t"))]
            found = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (key, "group_1", "group_2")] + [pa.array(f) for f in found],
                [key, "group_1", "group_2", *names],
            )

    return wanted.mapInArrow(count, f"{kinds}, " + ", ".join(f"{c} long" for c in names))


def signals() -> dict[str, Column]:
    """The signals from the counts; 0 for a text without words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    letters = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "symbol_share": F.col("n_symbols") / letters,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
        "long_word_excess": F.col("word_chars") / words,
    }


def adaptive_cutoffs(counted: DataFrame, least_texts: int = LEAST_TEXTS, sketch_size: int = SKETCH_SIZE) -> DataFrame:
    """One row per (group_1, group_2): the cutoff of each signal. Texts of fewer than ten words are not counted.

    A null language or source is a group like any other. A group without a text of ten words has no row; where no text
    has ten words, or there is none, there are no cutoffs and nothing exceeds one.
    """
    values = counted.where("n_words >= 10").select("group_1", "group_2", *[v.alias(k) for k, v in signals().items()])
    size = F.lit(sketch_size)
    own = values.groupBy("group_1", "group_2").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(s, size).alias(s) for s in SIGNALS]
    )
    by_language = own.groupBy("group_1").agg(
        F.sum("n").alias("n"), *[F.kll_merge_agg_double(s, size).alias(s) for s in SIGNALS]
    )
    # Over no text at all a merged sketch is empty and has no quantiles.
    of_all = by_language.groupBy().agg(
        F.sum("n").alias("n"), *[F.kll_merge_agg_double(s, size).alias(s) for s in SIGNALS]
    ).where("n > 0")

    def cutoff(s):
        low, high = (F.kll_sketch_get_quantile_double(F.col(s), F.lit(q)) for q in (0.25, 0.75))
        return high + F.greatest(F.lit(FENCE) * (high - low), F.lit(LEAST_FENCE[s]))

    def pack(frame, name, *keys):
        return frame.select(*keys, F.struct(F.col("n"), *[cutoff(s).alias(s) for s in SIGNALS]).alias(name))

    groups = pack(own, "own", "group_1", "group_2").alias("g")
    languages = pack(by_language, "language", "group_1").alias("l")
    joined = groups.join(languages, F.col("g.group_1").eqNullSafe(F.col("l.group_1")), "left")
    everything = (pack(of_all, "everything").first() or [None])[0]  # a single row
    few = lambda part: F.coalesce(F.col(f"{part}.n"), F.lit(0)) < F.lit(least_texts)
    chosen = [
        F.when(few("own") & few("language"), F.lit(everything[s] if everything else None).cast("double"))
        .when(few("own"), F.col(f"language.{s}"))
        .otherwise(F.col(f"own.{s}"))
        .alias(f"most_{s}")
        for s in SIGNALS
    ]
    return joined.select(F.col("g.group_1").alias("group_1"), F.col("g.group_2").alias("group_2"), *chosen)


def apply_cutoffs(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The counted rows with base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated three-word windows. kept: neither that nor
    a signal above the cutoff of its group; a group without cutoffs has none to exceed.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.lit(False)
    for s, value in signals().items():
        over = over | F.coalesce(value > F.col(f"most_{s}"), F.lit(False))
    c, m = counted.alias("c"), cutoffs.alias("m")
    same = F.col("c.group_1").eqNullSafe(F.col("m.group_1")) & F.col("c.group_2").eqNullSafe(F.col("m.group_2"))
    joined = c.join(m, same, "left").withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~over)
    return joined.select(*[F.col(f"c.`{n}`") for n in counted.columns], "base_failed", "kept")
