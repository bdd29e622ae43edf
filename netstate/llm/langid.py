"""Language identification with a byte convolutional network.

One-hot bytes of fixed-length windows go through filters of several widths, rectification and max pooling; a softmax
layer gives the languages. The network is trained in numpy on labelled texts and applied to every window of a text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm import text as T

UNKNOWN = "und"
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled texts per language that a fit may read, and windows taken from each.
TEXTS_PER_LANGUAGE = 600
WINDOWS_PER_TEXT = 4


@dataclass
class ByteNetwork:
    """Weights: for each width, (width, 256, filters) and a bias; then a softmax layer."""

    languages: list[str]
    window: int = WINDOW
    widths: tuple[int, ...] = WIDTHS
    filters: int = FILTERS
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        for w in self.widths:
            self.weights[f"conv{w}"] = rng.normal(0, 0.3 / np.sqrt(w), (w, 256, self.filters)).astype(np.float32)
            self.weights[f"conv{w}"][:, 0] = 0  # padding
            self.weights[f"bias{w}"] = np.zeros(self.filters, np.float32)
        size = len(self.widths) * self.filters
        self.weights["out"] = rng.normal(0, 0.1, (size, len(self.languages))).astype(np.float32)
        self.weights["out_bias"] = np.zeros(len(self.languages), np.float32)

    def forward(self, x: np.ndarray):
        """Pooled activations, the positions they come from, and class probabilities of windows x."""
        pooled, places = [], []
        for w in self.widths:
            conv, size = self.weights[f"conv{w}"], x.shape[1] - w + 1
            total = conv[0][x[:, :size]]
            for k in range(1, w):
                total += conv[k][x[:, k : k + size]]
            place = total.argmax(1)
            pooled.append(np.take_along_axis(total, place[:, None], 1)[:, 0] + self.weights[f"bias{w}"])
            places.append(place)
        hidden = np.maximum(np.concatenate(pooled, 1), 0)
        return hidden, places, softmax(hidden @ self.weights["out"] + self.weights["out_bias"])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 1):
        self.start(seed)
        rng, step = np.random.default_rng(seed), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for begin in range(0, len(order), batch):
                chosen = order[begin : begin + batch]
                bx, by, step = x[chosen], y[chosen], step + 1
                hidden, places, p = self.forward(bx)
                p[np.arange(len(by)), by] -= 1
                p /= len(by)
                grads = {"out": hidden.T @ p, "out_bias": p.sum(0)}
                back = (p @ self.weights["out"].T) * (hidden > 0)
                for i, w in enumerate(self.widths):
                    g = back[:, i * self.filters : (i + 1) * self.filters]
                    grads[f"bias{w}"] = g.sum(0)
                    conv = np.zeros_like(self.weights[f"conv{w}"])
                    column = np.broadcast_to(np.arange(self.filters), g.shape)
                    for k in range(w):
                        np.add.at(conv[k], (np.take_along_axis(bx, places[i] + k, 1), column), g)
                    conv[:, 0] = 0
                    grads[f"conv{w}"] = conv
                for name, g in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    scale = rate / (1 - 0.9**step)
                    self.weights[name] -= scale * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self

    def predictor(self):
        """A function from windows to class probabilities that looks two bytes up at once."""
        pairs = {}
        for w in self.widths:
            conv = self.weights[f"conv{w}"]
            pairs[w] = [
                (k, (conv[k][:, None, :] + conv[k + 1][None, :, :]).reshape(65536, self.filters))
                for k in range(0, w - 1, 2)
            ] + ([(w - 1, conv[w - 1])] if w % 2 else [])

        def predict(x: np.ndarray) -> np.ndarray:
            wide = x.astype(np.int64)
            two = wide[:, :-1] * 256 + wide[:, 1:]
            pooled = []
            for w in self.widths:
                size = x.shape[1] - w + 1
                total = None
                for k, table in pairs[w]:
                    index = two if len(table) == 65536 else wide
                    part = table.take(index[:, k : k + size], axis=0, mode="clip")
                    total = part if total is None else np.add(total, part, out=total)
                pooled.append(total.max(1) + self.weights[f"bias{w}"])
            hidden = np.maximum(np.concatenate(pooled, 1), 0)
            return softmax(hidden @ self.weights["out"] + self.weights["out_bias"])

        return predict


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def windows_of(data: np.ndarray, borders: np.ndarray, window: int, overlap: int):
    """Window starts, the text each belongs to and its end; together the windows cover every byte of every text."""
    lengths = np.diff(borders)
    stride = window - overlap
    counts = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - window) // stride)), 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return borders[:-1][owner] + number * stride, owner, borders[1:][owner]


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Lower-cased windows, filled with zeros after the end of their text."""
    index = starts[:, None] + np.arange(window)
    return np.where(index < ends[:, None], T.LOWER[data[np.minimum(index, len(data) - 1)]], 0)


def train_language_network(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang",
    texts_per_language: int = TEXTS_PER_LANGUAGE, seed: int = 11,
) -> ByteNetwork:
    """Fit on at most twice `texts_per_language` labelled texts of each language (about that many, chosen by hash).

    Rows without text or language are left out. Without any labelled row the network knows no language.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(language).alias("g"))
    rows = rows.where(F.col("t").rlike("\\p{L}") & F.col("g").isNotNull())
    table = T.hash_sample(rows, "k", "g", texts_per_language, seed).select("k", "t", "g").toArrow().sort_by("k")
    labels = table.column("g").to_pylist()
    network = ByteNetwork(sorted(set(labels)))
    if not labels:
        return network
    classes = np.array([network.languages.index(g) for g in labels])
    rng, xs, ys = np.random.default_rng(seed), [], []
    for first, data, borders in T.runs(table.column("t")):
        starts, owner, ends = windows_of(data, borders, network.window, max(network.widths) - 1)
        order = rng.permutation(len(starts))
        _, place = np.unique(owner[order], return_index=True)
        rank = np.empty(len(order), np.int64)  # number of a window within its text, in random order
        by_owner = order[np.argsort(owner[order], kind="stable")]
        counts = np.bincount(owner, minlength=len(borders) - 1)
        rank[by_owner] = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = rank < WINDOWS_PER_TEXT
        xs.append(cut(data, starts[keep], ends[keep], network.window))
        ys.append(classes[first + owner[keep]])
    return network.fit(np.concatenate(xs), np.concatenate(ys), seed=seed)


def identify_language(docs: DataFrame, network: ByteNetwork, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (mean probability over the windows, weighted by their letters) of every row.

    A text that is null or has no letter gets `und` with score 0, as does any text if the network knows no language.
    Repeated rows give repeated results; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)
    kind = docs.schema[key].dataType.simpleString()

    def score(batches):
        net = sent.value
        predict = net.predictor() if net.languages else None
        letter = np.zeros(256, np.float32)
        letter[0x61:0x7B] = letter[0x80:] = 1
        for batch in batches:
            n = batch.num_rows
            total = np.zeros((n, max(1, len(net.languages))))
            for first, data, borders in T.runs(batch.column("t")) if predict else ():
                starts, owner, ends = windows_of(data, borders, net.window, max(net.widths) - 1)
                for i in range(0, len(starts), 96):
                    x = cut(data, starts[i : i + 96], ends[i : i + 96], net.window)
                    weight = letter[x].sum(1) + 1e-3
                    np.add.at(total, first + owner[i : i + 96], predict(x) * weight[:, None])
            named = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool) & (total.sum(1) > 0)
            total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
            best = total.argmax(1)
            names = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, named)]
            scores = np.where(named, np.minimum(total[np.arange(n), best], 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(names, pa.string()), pa.array(scores)], [key, "lang_pred", "score"]
            )

    wanted = docs.select(
        F.col(key), F.col(text).alias("t"), F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("letters")
    )
    return wanted.mapInArrow(score, f"`{key}` {kind}, lang_pred string, score double")
