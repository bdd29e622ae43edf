"""Benchmark decontamination: item-sized windows of texts within an edit distance of benchmark items.

Words are the symbols. A window of an item's size that is within k edits shares all but 2k of its neighbouring word pairs,
so windows are first counted against bit maps of the items' pairs (nothing is lost). For the others, the CGK embedding
walks through the window: at step j it writes the word it stands on and moves on if a random function of (j, word) says
so, which turns few edits into few differing places. Samples of places are hashed, once for each repetition with its own
random functions; windows and items that share a hash are compared by exact edit distance. The number of
repetitions follows from the wanted recall, measured for each size on edited copies of items. A whole text that lacks at
most the allowed number of an item's words is a window of that item, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm import text as T
from netstate.scale import stage

#: Edits allowed as a share of an item's words, words of the shortest item that is searched, and the recall to reach.
EDITS = 0.2
LEAST_WORDS = 5
RECALL = 0.97
MOST_REPETITIONS = 256
SAMPLES = 2
PAIR_BITS = 22
SIZED_BITS = 26
KEY_BITS = 26


@dataclass
class Search:
    """What a scan needs to know of the items: their sizes, bit maps of their pairs and hashes, and the repetitions.

    `short_repetitions` is for whole texts that are shorter than an item.
    """

    sizes: list[int]
    pairs: np.ndarray
    sized: np.ndarray
    keys: np.ndarray
    repetitions: int
    short_repetitions: int
    edits: float = EDITS
    samples: int = SAMPLES


def words_of(column: pa.Array):
    """(first row, word hashes, text borders among them) of runs of lower-cased texts."""
    for first, data, borders in T.runs(pc.utf8_lower(column)):
        starts, ends, owner = T.spans(data, borders, T.ALNUM)
        yield first, T.span_hashes(data, starts, ends), np.searchsorted(owner, np.arange(len(borders)))


def allowed(n: int, edits: float) -> int:
    return int(edits * n + 1e-9)


def padded(windows: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of several sizes in one array, with zeros behind them and at least one at the end; and their sizes."""
    sizes = np.concatenate([np.full(len(w), w.shape[1]) for w in windows])
    out = np.zeros((len(sizes), longest + 1), np.uint64)
    at = 0
    for w in windows:
        out[at : at + len(w), : w.shape[1]] = w
        at += len(w)
    return out, sizes


def embedding_hashes(windows: np.ndarray, sizes: np.ndarray, repetition: int, samples: int) -> np.ndarray:
    """Hash of the sampled places of the embedding of every window; windows as `padded` gives them.

    The embedding of n words has 2n places. Whether a step moves on is the top bit of the word's hash times a random
    odd number of this step and repetition.
    """
    shares = np.random.default_rng([repetition, 17]).random(samples)
    longest = int(sizes.max(initial=0))
    steps = np.arange(2 * longest + 1, dtype=np.uint64) + np.uint64(repetition << 32)
    factors = T.mix(steps) | np.uint64(1)
    places = [(share * 2 * sizes).astype(np.int64) for share in shares]
    found = [np.zeros(len(sizes), np.uint64) for _ in shares]
    at, rows = np.zeros(len(sizes), np.int64), np.arange(len(sizes)) * windows.shape[1]
    flat = windows.ravel()
    for step in range(max((int(p.max(initial=0)) for p in places), default=0) + 1):
        word = flat[rows + at]
        for place, held in zip(places, found):
            np.copyto(held, word, where=place == step)
        at += ((word * factors[step]) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, sizes, out=at)
    out = T.mix(sizes.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(repetition))
    for held in found:
        out = T.pair(out, held)
    return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact edit distances of the rows of a and b, which may differ in width."""
    count, n = b.shape
    index = np.arange(n + 1)
    row = np.broadcast_to(index, (count, n + 1)).copy()
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b))
        row = np.minimum.accumulate(new - index, axis=1) + index
    return row[:, -1]


#: Kinds of copies that a search must find: words replaced; as many inserted as deleted; deleted only (a shorter whole text).
COPIES = ("replaced", "shifted", "shortened")


def edited(items: np.ndarray, edits: int, kind: str, rng: np.random.Generator) -> list[np.ndarray]:
    """A copy of each row with so many random edits of a kind; the odd edit of `shifted` replaces a word."""
    out = []
    for words in items:
        fresh = rng.integers(1, 1 << 62, edits, dtype=np.uint64)
        where = rng.choice(len(words), edits, replace=False)
        deleted = {"replaced": 0, "shifted": edits // 2, "shortened": edits}[kind]
        inserted = deleted if kind == "shifted" else 0
        own = words.copy()
        replaced = edits - deleted - inserted
        own[where[:replaced]] = fresh[:replaced]
        own = np.delete(own, where[replaced : replaced + deleted])
        out.append(np.insert(own, rng.integers(0, len(own) + 1, inserted), fresh[edits - inserted :]))
    return out


def repetitions_for(sizes: list[int], edits: float, samples: int, recall: float, seed: int = 3, kinds: tuple[str, ...] = COPIES[:2]) -> int:
    """Repetitions that find this share of the windows of each size and kind of copy with as many edits as allowed.

    Measured on random words for up to eight of the sizes, the least and the greatest among them. It is an error if
    MOST_REPETITIONS do not reach the recall.
    """
    rng = np.random.default_rng(seed)
    most = 1
    for n in [sizes[i] for i in np.unique(np.linspace(0, len(sizes) - 1, 8).astype(int))] if sizes else []:
        for kind in kinds:
            one, width = padded([rng.integers(1, 1 << 62, (100, n), dtype=np.uint64)], n)
            copies = np.zeros_like(one)
            for held, copy in zip(copies, edited(one[:, :n], allowed(n, edits), kind, rng)):
                held[: len(copy)] = copy
            hit, repetition = np.zeros(len(one), bool), 0
            while hit.mean() < recall:
                if repetition == MOST_REPETITIONS:
                    raise ValueError(f"{MOST_REPETITIONS} repetitions find {hit.mean():.2f} of the copies of {n} words ({kind}), not {recall}.")
                hit |= embedding_hashes(one, width, repetition, samples) == embedding_hashes(copies, width, repetition, samples)
                repetition += 1
            most = max(most, repetition)
    return most


def item_rows(items: DataFrame, key: str, text: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """(item, n, words): the word hashes of every item that is long enough."""
    kind = items.schema[key].dataType.simpleString()

    def read(batches):
        for batch in batches:
            out = [[], [], []]
            for first, words, ends in words_of(batch.column("t")):
                for i in range(len(ends) - 1):
                    own = words[ends[i] : ends[i + 1]].view(np.int64)
                    if len(own) >= least_words:
                        out[0].append(first + i)
                        out[1].append(len(own))
                        out[2].append(own.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64()))],
                ["item", "n", "words"],
            )

    wanted = items.where(F.col(text).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("t"))
    return wanted.mapInArrow(read, f"item {kind}, n int, words array<long>")


def _sized(pairs: np.ndarray, n) -> np.ndarray:
    return T.pair(pairs, np.uint64(0) + np.uint64(n)) >> np.uint64(64 - SIZED_BITS)


def item_keys(items: DataFrame, repetitions: int, samples: int) -> DataFrame:
    """(item, n, words, key) for every repetition."""
    kind = items.schema["item"].dataType.simpleString()

    def make(batches):
        for batch in batches:
            at, keys = [], []
            for i, words in enumerate(batch.column("words")):
                window = np.array(words.as_py(), np.int64).view(np.uint64)[None]
                one, size = padded([window], window.shape[1])
                keys += [embedding_hashes(one, size, r, samples)[0] for r in range(repetitions)]
                at += [i] * repetitions
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(np.array(keys, np.uint64).view(np.int64))], ["item", "n", "words", "key"]
            )

    return items.mapInArrow(make, f"item {kind}, n int, words array<long>, key long")


def bit_map(rows: DataFrame, bits: int, positions) -> np.ndarray:
    """A bit map of 2**bits bits from the positions of every Arrow batch; joined by bitwise or before it reaches the driver."""

    def fill(batches):
        held = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            where = positions(batch)
            np.bitwise_or.at(held, where >> np.uint64(6), np.uint64(1) << (where & np.uint64(63)))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used].view(np.int64))], ["at", "bits"])

    table = rows.mapInArrow(fill, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def is_set(held: np.ndarray, where: np.ndarray) -> np.ndarray:
    return (held[where >> np.uint64(6)] >> (where & np.uint64(63)) & np.uint64(1)).astype(bool)


def prepare(items: DataFrame, edits: float = EDITS, samples: int = SAMPLES, recall: float = RECALL) -> tuple[Search, DataFrame]:
    """The search and the table of item hashes. What goes to the driver is bounded: item sizes and three bit maps."""
    sizes = sorted(r[0] for r in items.select("n").distinct().collect())
    repetitions = repetitions_for(sizes, edits, samples, recall)
    short = repetitions_for(sizes, edits, samples, recall, kinds=COPIES[2:])
    keys = stage(item_keys(items, max(repetitions, short), samples))

    def pair_places(sized):
        def places(batch):
            parts = []
            for n, words in zip(batch.column("n").to_pylist(), batch.column("words")):
                own = np.array(words.as_py(), np.int64).view(np.uint64)
                pairs = T.pair(own[:-1], own[1:])
                parts.append(_sized(pairs, n) if sized else pairs >> np.uint64(64 - PAIR_BITS))
            return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

        return places

    def key_places(batch):
        return batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - KEY_BITS)

    search = Search(
        sizes, bit_map(items, PAIR_BITS, pair_places(False)), bit_map(items, SIZED_BITS, pair_places(True)),
        bit_map(keys, KEY_BITS, key_places), repetitions, short, edits, samples,
    )
    return search, keys


def candidate_windows(words: np.ndarray, ends: np.ndarray, search: Search):
    """(start, size) of the windows that share enough pairs with the items of their size."""
    m = len(words)
    if m < 2 or not search.sizes:
        return
    owner_end = np.repeat(ends[1:], np.diff(ends))
    pairs = T.pair(words[:-1], words[1:])
    known = is_set(search.pairs, pairs >> np.uint64(64 - PAIR_BITS))
    known &= np.arange(1, m) < owner_end[:-1]
    sums = np.zeros(m + 1, np.int32)
    np.cumsum(known, out=sums[1:m])
    sums[m] = sums[m - 1]
    need = {n: max(1, n - 1 - 2 * allowed(n, search.edits)) for n in search.sizes}
    at = np.arange(m)
    i = 0
    while i < len(search.sizes):
        j = i
        while j + 1 < len(search.sizes) and search.sizes[j + 1] <= 1.25 * search.sizes[i] + 1:
            j += 1
        group = search.sizes[i : j + 1]
        # A window of the longest size of the group holds all pairs of a shorter one with the same start.
        most = sums[np.minimum(at + group[-1] - 1, owner_end - 1)] - sums[:m]
        starts = np.flatnonzero((most >= min(need[n] for n in group)) & (at + group[0] <= owner_end))
        for n in group if len(starts) else ():
            own = starts[starts + n <= owner_end[starts]]
            own = own[sums[own + n - 1] - sums[own] >= need[n]]
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                inside = pairs[part[:, None] + np.arange(n - 1)]
                good = is_set(search.sized, _sized(inside, n)).sum(1) >= need[n]
                if good.any():
                    yield part[good], n
        i = j + 1


def short_texts(words: np.ndarray, ends: np.ndarray, search: Search):
    """(start, words, size) of the whole texts that lack at most the allowed words of a size and share enough pairs with its items."""
    lengths = np.diff(ends)
    if len(words) < 2:
        return
    pairs = T.pair(words[:-1], words[1:])
    present = np.unique(lengths[lengths > 0])
    for n in search.sizes:
        k = allowed(n, search.edits)
        for m in present[np.searchsorted(present, n - k) : np.searchsorted(present, n)]:
            at = ends[:-1][lengths == m]
            shared = is_set(search.sized, _sized(pairs[at[:, None] + np.arange(m - 1)], n)).sum(1)
            at = at[shared >= n - 1 - 2 * k]
            if len(at):
                yield at, m, n


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """(key, item_key, start, n_words, distance): the best window of each text for each item it holds; n_words is the item's size.

    start counts words (runs of digits, letters and non-ASCII characters, in lower case). Items of fewer than LEAST_WORDS
    words, and null ones, are not searched for; equal items are found each. Rows that share a key are treated as parts of
    one text. Null and empty texts hold nothing. Names of docs and items may clash.
    """
    listed = stage(item_rows(items, item_key, item_text))
    search, keys = prepare(listed, edits, SAMPLES, recall)
    sent = docs.sparkSession.sparkContext.broadcast(search)
    kind = docs.schema[key].dataType.simpleString()
    item_kind = items.schema[item_key].dataType.simpleString()

    def scan(batches):
        s = sent.value
        longest = max(s.sizes, default=0)
        for batch in batches:
            rows, starts, windows = [], [], []
            short_rows, short_windows, short_sizes = [], [], []
            for first, words, ends in words_of(batch.column("t")):
                for at, n in candidate_windows(words, ends, s):
                    home = np.searchsorted(ends, at, "right") - 1
                    rows.append(first + home)
                    starts.append(at - ends[home])
                    windows.append(words[at[:, None] + np.arange(n)])
                for at, m, n in short_texts(words, ends, s):
                    short_rows.append(first + np.searchsorted(ends, at, "right") - 1)
                    short_windows.append(words[at[:, None] + np.arange(m)])
                    short_sizes.append(np.full(len(at), n))
                if sum(map(len, rows)) > 50_000:
                    held, sizes = padded(windows, longest)
                    yield from hashed(s, batch, rows, starts, held, sizes, sizes, s.repetitions)
                    rows, starts, windows = [], [], []
                if sum(map(len, short_rows)) > 50_000:
                    yield from hashed_short(s, batch, short_rows, short_windows, short_sizes, longest)
                    short_rows, short_windows, short_sizes = [], [], []
            if rows:
                held, sizes = padded(windows, longest)
                yield from hashed(s, batch, rows, starts, held, sizes, sizes, s.repetitions)
            if short_rows:
                yield from hashed_short(s, batch, short_rows, short_windows, short_sizes, longest)

    def hashed_short(s, batch, rows, windows, sizes, longest):
        held, lengths = padded(windows, longest)
        starts = [np.zeros(len(held), np.int64)]
        yield from hashed(s, batch, rows, starts, held, lengths, np.concatenate(sizes), s.short_repetitions)

    def hashed(s, batch, rows, starts, held, lengths, sizes, repetitions):
        rows, starts = np.concatenate(rows), np.concatenate(starts)
        for r in range(repetitions):
            keys_ = embedding_hashes(held, sizes, r, s.samples)
            hit = np.flatnonzero(is_set(s.keys, keys_ >> np.uint64(64 - KEY_BITS)))
            n, m = sizes[hit], lengths[hit]
            inside = np.arange(held.shape[1]) < m[:, None]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32)), pa.array(held[hit][inside].view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows[hit])), pa.array(starts[hit]), pa.array(n.astype(np.int32)),
                 pa.array(keys_[hit].view(np.int64)), lists], ["id", "start", "n", "key", "window"],
            )

    def verify(batches):
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            lengths = pc.list_value_length(batch.column("window")).to_numpy()
            distance = np.zeros(len(sizes), np.int64)
            for m, n in np.unique(np.stack([lengths, sizes], 1), axis=0).tolist():
                at = np.flatnonzero((lengths == m) & (sizes == n))
                taken = batch.take(pa.array(at))
                a, b = (taken.column(c).flatten().to_numpy().reshape(-1, w) for c, w in (("window", m), ("words", n)))
                distance[at] = edit_distances(a, b)
            good = pa.array(distance <= edits * sizes + 1e-9)
            names = ["id", "item", "start", "n"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).filter(good) for c in names], pa.array(distance).filter(good)], [*names, "distance"]
            )

    wanted = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    windows = wanted.mapInArrow(scan, f"id {kind}, start long, n int, key long, window array<long>")
    near = windows.join(keys, ["key", "n"]).dropDuplicates(["id", "start", "item", "n", "window"]).select("id", "item", "start", "n", "window", "words")
    exact = near.mapInArrow(verify, f"id {kind}, item {item_kind}, start long, n int, distance long")
    best = exact.groupBy("id", "item").agg(F.min(F.struct("distance", "start", "n")).alias("best"))
    return best.select(
        F.col("id").alias(key), F.col("item").alias(item_key), F.col("best.start").alias("start"), F.col("best.n").cast("long").alias("n_words"),
        F.col("best.distance").alias("distance"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """The rows of docs, with their columns, whose text holds no item. Rows with a null key stay only if none of them holds one."""
    found = stage(find_leaks(docs, items, key, text, item_key, item_text, edits).select(F.col(key).alias("_leak")).distinct())
    return docs.alias("d").join(found.alias("f"), F.col(f"d.`{key}`").eqNullSafe(F.col("f._leak")), "left_anti")
