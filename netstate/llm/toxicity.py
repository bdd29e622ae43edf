"""Toxicity scores: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Each n-gram present in a text is a feature with the value of its log-count ratio, the logarithm of how much more of the
toxic than of the other texts hold it. Logistic regression weighs these features. Only n-grams that tell the classes apart
are features; each keeps its own 32-bit hash, so that the many other n-grams of a long text do not count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm import text as T

ORDERS = (3, 4, 5, 6, 7)
#: Bits of an n-gram's hash, and of the map that is asked before a hash is looked up among the features.
BITS = 32
MAP_BITS = 22
#: Ranges of hashes that are counted one after the other in a fit.
PARTS = 64
#: An n-gram needs so many labelled texts, and a log-count ratio of so many standard errors, to be a feature.
LEAST_TEXTS = 3
LEAST_ERRORS = 3.5
#: Labelled texts of each class that a fit may read, and the longest of them in bytes.
TEXTS_PER_CLASS = 2000
TRAIN_BYTES = 40_000


@dataclass
class Scaled:
    """Intercept, and the sorted hashes of the features with the product of ratio and weight of each."""

    intercept: float
    hashes: np.ndarray
    weights: np.ndarray
    orders: tuple[int, ...] = ORDERS


def grams_of(data: np.ndarray, borders: np.ndarray, orders=ORDERS):
    """(n, hashes, text borders) of the n-grams that start at each character of a run, of every order."""
    codes, ends = T.characters(data, borders)
    codes = np.where((codes >= 0x80) | ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57)), codes, 32)
    codes = codes.astype(np.uint32)
    for n in orders:
        yield n, T.gram_hashes(codes, n, BITS).astype(np.uint32), ends


def distinct_grams(data: np.ndarray, borders: np.ndarray, orders=ORDERS):
    """The sorted distinct n-gram hashes of one text after the other."""
    grams = list(grams_of(data, borders, orders))
    for i in range(len(borders) - 1):
        yield np.unique(np.concatenate([g[ends[i] : max(ends[i], ends[i + 1] - n + 1)] for n, g, ends in grams]))


class Found:
    """Which features the texts of a run hold."""

    def __init__(self, model: Scaled):
        self.model, self.map = model, np.zeros(1 << MAP_BITS, bool)
        self.map[model.hashes >> np.uint32(BITS - MAP_BITS)] = True

    def sums(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Sum of the weights of the distinct features of each text."""
        m, n_texts = self.model, len(borders) - 1
        held = [np.zeros(0, np.int64)]
        for n, grams, ends in grams_of(data, borders, m.orders) if len(m.hashes) else ():
            at = np.flatnonzero(self.map[grams >> np.uint32(BITS - MAP_BITS)])
            feature = np.minimum(np.searchsorted(m.hashes, grams[at]), len(m.hashes) - 1)
            owner = np.searchsorted(ends, at, "right") - 1
            real = (m.hashes[feature] == grams[at]) & (at + n <= ends[owner + 1])
            held.append(np.unique(owner[real] * len(m.hashes) + feature[real]))
        both = np.unique(np.concatenate(held))
        if not len(both):
            return np.zeros(n_texts)
        return np.bincount(both // len(m.hashes), m.weights[both % len(m.hashes)], n_texts)


def features_of(grams: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-count ratios of the n-grams that tell the classes apart; grams holds each text's sorted hashes."""
    edges = np.arange(1, PARTS, dtype=np.uint64) << np.uint64(BITS)
    edges = (edges // np.uint64(PARTS)).astype(np.uint32)
    cuts = [np.concatenate([[0], np.searchsorted(g, edges), [len(g)]]) for g in grams]
    hashes, ratios = [], []
    for part in range(PARTS):
        own = [g[c[part] : c[part + 1]] for g, c in zip(grams, cuts)]
        values, counts = np.unique(np.concatenate(own), return_counts=True)
        values, counts = values[counts >= LEAST_TEXTS], counts[counts >= LEAST_TEXTS]
        bad, n_bad = np.unique(np.concatenate([g for g, label in zip(own, y) if label]), return_counts=True)
        toxic = np.zeros(len(values))
        if len(values) and len(bad):
            at = np.minimum(np.searchsorted(bad, values), len(bad) - 1)
            toxic = np.where(bad[at] == values, n_bad[at], 0).astype(float)
        other = counts - toxic + 1
        toxic += 1
        ratio = np.log(toxic / (y.sum() + 2)) - np.log(other / ((1 - y).sum() + 2))
        clear = np.abs(ratio) >= LEAST_ERRORS * np.sqrt(1 / toxic + 1 / other)
        hashes.append(values[clear])
        ratios.append(ratio[clear])
    return np.concatenate(hashes), np.concatenate(ratios)


def train_toxicity(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    texts_per_class: int = TEXTS_PER_CLASS, docs: DataFrame | None = None, rounds: int = 200, seed: int = 5,
) -> Scaled:
    """Fit on about `texts_per_class` labelled texts of each class (twice that at most), of at most TRAIN_BYTES bytes.

    With `docs`, the table the texts come from, only the chosen texts leave their scan.

    Rows whose label is not 0 or 1 are left out. The classes count alike in the fit; the intercept is then moved half of the
    way (in log odds) to the share of toxic rows among all labelled rows, so that rare toxic texts are still found. With one class only, or none, every text gets that class's share, or 0.
    """
    rows = labelled.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & (F.octet_length("t") <= TRAIN_BYTES))
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    texts = None
    if docs is not None:
        texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.octet_length("t") <= TRAIN_BYTES)
    table = T.hash_sample(rows, "k", "y", texts_per_class, seed, texts).select("k", "t", "y").toArrow().sort_by("k")
    y = np.array(table.column("y").to_pylist(), float)
    if len(counts) < 2 or not 0 < y.sum() < len(y):
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return Scaled(float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0, np.uint32), np.zeros(0))
    grams = []
    for _, data, borders in T.runs(table.column("t")):
        grams += distinct_grams(data, borders)
    hashes, ratio = features_of(grams, y)
    size = len(hashes)
    grams = [np.flatnonzero(np.isin(hashes, g, assume_unique=True, kind="sort")) for g in grams]
    index, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    value = ratio[index]
    v, b = np.zeros(size), 0.0
    m, s = np.zeros(size), np.zeros(size)
    balance = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    mb = sb = 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(owner, v[index] * value, len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / len(y)
        grad = np.bincount(index, value * g[owner], size) + 1e-4 * v
        m += 0.1 * (grad - m)
        s += 0.01 * (grad * grad - s)
        v -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        mb += 0.1 * (g.sum() - mb)
        sb += 0.01 * (g.sum() ** 2 - sb)
        b -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-8)
    return Scaled(float(b + 0.5 * np.log(counts[1] / counts[0])), hashes, v * ratio)


def score_toxicity(docs: DataFrame, model: Scaled, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every row. A null text is an empty one; it gets the score of a text without n-grams.

    Only the key and the whole text are read; repeated rows give repeated results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def score(batches):
        m = sent.value
        found = Found(m)
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for first, data, borders in T.runs(batch.column("t")):
                z[first : first + len(borders) - 1] = found.sums(data, borders)
            scores = 1 / (1 + np.exp(-np.clip(z + m.intercept, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(scores)], [key, "score"])

    return docs.select(F.col(key), F.col(text).alias("t")).mapInArrow(score, f"`{key}` {kind}, score double")
