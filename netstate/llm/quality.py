"""Quality grades: cumulative-link regression on hashed character and word features.

All grades share one weight vector. Ordered thresholds cut the score into grades: P(grade > k) = logistic(score - cut_k).
Features are relative frequencies of hashed character 1- to 3-grams and of words that repeat the word before them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm import text as T

ORDERS = (1, 2, 3)
BITS = 16
SCALE = 20.0
#: Rated texts of each grade that a fit may read, and the longest of them in bytes.
TEXTS_PER_GRADE = 1500
TRAIN_BYTES = 40_000


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    cuts: np.ndarray


def repeats(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Share of each text's words that equal the word before."""
    starts, ends, owner = T.spans(data, borders, T.NOT_SPACE)
    words = T.span_hashes(data, starts, ends)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    n = len(borders) - 1
    return np.bincount(owner, same, n) / np.maximum(1, np.bincount(owner, minlength=n))


def raw_scores(data: np.ndarray, borders: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of weight times feature for each text of a run."""
    codes, ends = plain_characters(data, borders)
    n = len(borders) - 1
    score = repeats(data, borders) * SCALE * weights[1 << BITS]
    for order in ORDERS:
        total = np.zeros(len(codes) + 1)
        grams = T.gram_hashes(codes, order, BITS)
        np.cumsum(weights[grams], dtype=float, out=total[1 : len(grams) + 1])
        last = np.maximum(ends[:-1], ends[1:] - order + 1)
        score += SCALE * (total[last] - total[ends[:-1]]) / np.maximum(1, last - ends[:-1])
    return score if n else score[:0]


def plain_characters(data: np.ndarray, borders: np.ndarray):
    """Code points with their case, and the text borders among them."""
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=counts[1:])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return (codes, counts[borders]) if len(codes) == counts[-1] else (data.astype(np.uint32), borders)


def features(data: np.ndarray, borders: np.ndarray):
    """For each text the feature numbers and values that raw_scores weighs."""
    codes, ends = plain_characters(data, borders)
    grams = [(n, T.gram_hashes(codes, n, BITS)) for n in ORDERS]
    for i, share in enumerate(repeats(data, borders)):
        index, value = [np.array([1 << BITS])], [np.array([share * SCALE])]
        for n, g in grams:
            own = g[ends[i] : max(ends[i], ends[i + 1] - n + 1)]
            found, counts = np.unique(own, return_counts=True)
            index.append(found)
            value.append(SCALE * counts / max(1, len(own)))
        yield np.concatenate(index), np.concatenate(value)


def train_quality(
    rated: DataFrame, key: str = "doc_id", text: str = "text", rating: str = "rating",
    texts_per_grade: int = TEXTS_PER_GRADE, docs: DataFrame | None = None, rounds: int = 150, seed: int = 3,
) -> Ordinal:
    """Fit on about `texts_per_grade` rated texts of each grade (twice that at most), of at most TRAIN_BYTES bytes.

    With `docs`, the table the texts come from, only the chosen texts leave their scan.

    Grades are whole numbers; rows without one are left out. Each grade counts as often as all rated rows hold it.
    With fewer than two grades the model knows one grade and gives it to every text.
    """
    rows = rated.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(rating).cast("int").alias("y"))
    rows = rows.where(F.col("y").isNotNull() & (F.octet_length("t") <= TRAIN_BYTES))
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    texts = None
    if docs is not None:
        texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.octet_length("t") <= TRAIN_BYTES)
    table = T.hash_sample(rows, "k", "y", texts_per_grade, seed, texts).select("k", "t", "y").toArrow().sort_by("k")
    ratings = np.array(table.column("y").to_pylist(), int)
    grades = sorted(set(ratings.tolist()))
    size = (1 << BITS) + 1
    if len(grades) < 2:
        return Ordinal(grades or [0], np.zeros(size, np.float32), np.zeros(0))
    y = np.searchsorted(grades, ratings)
    share = np.array([counts[g] for g in grades], float)
    weight = (share / share.sum() / np.maximum(1, np.bincount(y, minlength=len(grades))))[y]
    index, value, owner = [], [], []
    number = 0
    for _, data, borders in T.runs(table.column("t")):
        for i, v in features(data, borders):
            index.append(i.astype(np.int32))
            value.append(v.astype(np.float32))
            owner.append(np.full(len(i), number, np.int32))
            number += 1
    index, value, owner = np.concatenate(index), np.concatenate(value), np.concatenate(owner)
    w, m, s = np.zeros(size), np.zeros(size), np.zeros(size)
    tail = 1 - np.cumsum(share / share.sum())[:-1]
    start = -np.log(tail / (1 - tail))
    # The first cut is free; the others follow by positive steps, so the cuts stay in order.
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    mc, sc = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, rounds + 1):
        cuts = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        z = np.bincount(owner, w[index] * value, len(y))
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30)))
        upper = np.concatenate([np.ones((len(y), 1)), above, np.zeros((len(y), 1))], 1)
        rows_ = np.arange(len(y))
        high, low = upper[rows_, y], upper[rows_, y + 1]
        p = np.maximum(high - low, 1e-9)
        g = -weight * (high * (1 - high) - low * (1 - low)) / p
        by_cut = np.zeros(len(cuts))
        np.add.at(by_cut, (y - 1)[y > 0], (weight * high * (1 - high) / p)[y > 0])
        np.add.at(by_cut, y[y < len(cuts)], (-weight * low * (1 - low) / p)[y < len(cuts)])
        grad = np.bincount(index, value * g[owner], size) + 1e-6 * w
        back = np.concatenate([[by_cut.sum()], np.exp(free[1:]) * np.cumsum(by_cut[::-1])[::-1][1:]])
        for target, slope, mean, square, rate in ((w, grad, m, s, 0.05), (free, back, mc, sc, 0.05)):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            target -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    cuts = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
    return Ordinal(grades, w.astype(np.float32), cuts)


def grade_quality(docs: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the key plus expected_grade and tails (P(grade >= g) for each grade but the lowest) of every row.

    A null text is an empty one, which has no features. Repeated rows give repeated results.
    """
    kind = docs.schema[key].dataType.simpleString()
    score = _scorer(docs, model, [key])
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(
        score, f"`{key}` {kind}, expected_grade double, tails array<double>"
    )


def _scorer(docs, model, keep):
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = sent.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for first, data, borders in T.runs(batch.column("_text")):
                z[first : first + len(borders) - 1] = raw_scores(data, borders, m.weights)
            tails = 1 / (1 + np.exp(-np.clip(z[:, None] - m.cuts, -40, 40)))
            expected = m.grades[0] + tails @ np.diff(np.array(m.grades, float))
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(z) + 1, dtype=np.int32) * tails.shape[1], pa.int32()), pa.array(tails.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(expected), flat], [*keep, "expected_grade", "tails"]
            )

    return score


def select_quality(docs: DataFrame, model: Ordinal, least: int, chance: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose probability of a grade of `least` or more is at least `chance`, with their own columns.

    A model that knows no grade of `least` keeps nothing; one whose lowest grade is `least` or more keeps everything.
    """
    if model.grades[0] >= least:
        return docs
    at = next((i for i, g in enumerate(model.grades[1:]) if g >= least), None)
    if at is None:
        return docs.limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, place = docs.columns, docs.columns.index(text)

    def keep(batches):
        m = sent.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for first, data, borders in T.runs(batch.column(place)):
                z[first : first + len(borders) - 1] = raw_scores(data, borders, m.weights)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z - m.cuts[at], -40, 40))) >= chance))

    return docs.mapInArrow(keep, docs.schema) if names else docs
