"""Near-duplicates by SimHash fingerprints, compared in vertical bit planes.

Fingerprints that differ in at most `radius` of 64 bits agree in at least blocks - radius of `blocks` bit blocks. Every
fingerprint is therefore filed under each choice of that many blocks; only fingerprints filed together are compared. Each
file is compared bit-sliced: 64 planes hold one bit of all its fingerprints, the bits that differ from a query are added to
a two-bit counter with an overflow flag (carry-save, 64 fingerprints to a machine word), and a comparison ends as soon as
every counter has overflowed. Distinct fingerprints only are compared; copies share theirs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.llm import superminhash as sets_of
from netstate.llm import text as T
from netstate.llm.components import connected_components
from netstate.scale import join_small, stage

RADIUS = 3
BLOCKS = 5
SHINGLE = 3
SEED = 42
#: Fingerprints of one file that one task compares; larger files are cut into pairs of parts.
FILE_ROWS = 8192
#: Small files that stand next to each other are compared in one piece of about this size.
PIECE_ROWS = 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, fingerprint (64 bits in a long) and the columns `keep` of every row.

    Words are runs of other characters than ASCII white space after lower-casing A-Z; shingles are joined by a space. A text
    with fewer words than a shingle is one shingle of all of them. A null text, or one without words, gets zero.
    """
    names = [key, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def compute(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for first, data, borders in T.runs(batch.column("_text")):
                content = data.tobytes().lower()
                hashes, owners = [], []
                for i in range(len(borders) - 1):
                    words = content[borders[i] : borders[i + 1]].split()  # bytes split at ASCII white space
                    if not words:
                        continue
                    joined = b" ".join(words)
                    ends = np.cumsum([len(w) + 1 for w in words]) - 1
                    begins = [0, *(ends[:-1] + 1).tolist()]
                    stops = ends[shingle - 1 :].tolist() or [len(joined)]
                    own = [digest(joined[a:b], SEED) for a, b in zip(begins, stops)]
                    hashes += own
                    owners.append((i, len(own)))
                if not owners:
                    continue
                bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
                counts = np.array([c for _, c in owners])
                starts = np.cumsum(counts) - counts
                ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                packed = np.packbits(2 * ones > counts[:, None], axis=1)
                out[first + np.array([i for i, _ in owners])] = packed.reshape(-1).view(">u8")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out.view(np.int64))], [*names, "fingerprint"])

    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(compute, f"{kinds}, fingerprint long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of blocks - radius blocks, as signed 64-bit numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(single[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit j of word w of plane p is bit p of fingerprint 64 w + j."""
    size = -(-len(prints) // 64) * 64
    padded = np.zeros(size, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, rows: int, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """(queries, rows): whether a query differs from a fingerprint in at most `radius` (0 to 3) bits.

    Planes are visited from the ends inwards in turn, so that bits outside the shared blocks come early.
    """
    shape = (len(queries), planes.shape[1])
    ones, twos, over = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
    spare = rows % 64
    if spare:
        over[:, -1] = ALL << np.uint64(spare)
    for number in range(64):
        p = (number * 37) % 64
        query = np.where((queries >> np.uint64(p)) & np.uint64(1), ALL, np.uint64(0))[:, None]
        differ = planes[p] ^ query
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if number % 8 == 7 and (over == ALL).all():
            return np.zeros((len(queries), rows), bool)
    counted = ~over
    if radius < 3:
        counted &= {2: ~(ones & twos), 1: ~twos, 0: ~(ones | twos)}[radius]
    return np.unpackbits(counted.view(np.uint8), axis=1, bitorder="little")[:, :rows].astype(bool)


def tree(prints: np.ndarray, radius: int = RADIUS, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the near pairs of `prints` connect: (print, root) with one row per linked print."""
    n = len(prints)
    planes, root = planes_of(prints), np.arange(n)

    def join(a, b):
        """Unite the sets of the roots a[i] and b[i]."""
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        parent: dict[int, int] = {}

        def top(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            new = np.arange(n)
            for x in parent:
                new[x] = top(x)
            root[:] = new[root]

    for begin in range(0, n, step):
        word = begin // 64
        near = within(planes[:, word:], n - word * 64, prints[begin : begin + step], radius)
        near[np.arange(len(near)), np.arange(begin, begin + len(near)) - word * 64] = False
        hit = np.flatnonzero(near.any(0))
        if not len(hit):
            continue
        chosen = near[:, hit].argmax(0) + begin
        join(root[chosen], root[hit + word * 64])
        q, r = np.nonzero(near[:, hit])
        join(root[q + begin], root[hit[r] + word * 64])
    linked = root != np.arange(n)
    return prints[linked], prints[root[linked]]


def near_links(prints: DataFrame, column: str = "fingerprint", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints of `prints` (one row each) that connect all pairs within `radius` bits.

    A file of more than FILE_ROWS fingerprints is dealt into parts; every pair of parts is compared by its own task, which
    holds two parts at most.
    """
    masks = block_masks(blocks, radius)
    # The bits of the file, with its number in the low bits of a second column.
    filed = prints.select(
        F.col(column).alias("p"), F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(column).bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])).alias("f")
    ).select("p", "f.t", "f.bits")
    large = filed.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FILE_ROWS)
    large = large.select("t", "bits", F.ceil(F.col("n") / F.lit(FILE_ROWS / 2)).cast("int").alias("parts"))
    placed = filed.join(large, ["t", "bits"], "left")
    part = F.pmod(F.xxhash64("p"), F.coalesce("parts", F.lit(1))).cast("int")
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = placed.withColumn("part", part).withColumn("other", F.explode(others))
    cells = cells.select(
        "p", "t", "bits", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    )
    keys = ["t", "bits", "i", "j"]

    def compare(batches):
        """Rows come sorted by file; whole files are put together to pieces of about PIECE_ROWS."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def done():
            p = np.concatenate([h[0] for h in held])
            p = np.unique(p).view(np.uint64)
            a, b = tree(p, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        last = None
        for batch in batches:
            p = batch.column("p").to_numpy()
            marks = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], 1)
            if not len(p):
                continue
            change = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(p)]])
            for a, b in zip(starts.tolist(), ends.tolist()):
                mark = tuple(marks[a])
                if mark != last and size >= PIECE_ROWS:
                    yield done()
                    held, size = [], 0
                last = mark
                held.append((p[a:b], marks[a:b]))
                size += b - a
        if held:
            yield done()

    sorted_ = cells.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, `keep`, fingerprint, component_id and root of every row; root is the least fingerprint of the component.

    Rows whose fingerprints differ in at most `radius` bits are linked; component_id is the least key that links lead to
    (null only if no row of the component has a key). Equal rows get equal results. An empty table gives no rows.
    """
    rows = stage(fingerprints(docs, key, text, keep=keep))
    prints = stage(rows.groupBy("fingerprint").agg(F.min(key).alias("least")))
    roots = connected_components(near_links(prints.select("fingerprint"), radius=radius))
    joined = prints.join(roots, prints["fingerprint"] == roots["node"], "left")
    joined = joined.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    classes = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = stage(joined.join(classes, "root").select("fingerprint", "component_id", "root"))
    return join_classes(rows, linked, [key, *keep])


def join_classes(rows: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the class of their fingerprint. Fingerprints that own more than a thousandth of the rows, fewer than a
    thousand, are looked up in a small table, all others by an ordinary join."""
    total = rows.count()
    counts = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(max(1000, total // 1000)))
    hot = F.broadcast(counts.join(classes, "fingerprint").select("fingerprint", F.struct("component_id", "root").alias("found")))
    split = rows.join(hot, "fingerprint", "left")
    names = [*columns, "fingerprint", "component_id", "root"]
    easy = split.where("found is not null").select(*columns, "fingerprint", "found.component_id", "found.root")
    other = split.where("found is null").drop("found").join(classes, "fingerprint").select(*names)
    return easy.union(other)


def hexadecimal(column: str | Column) -> Column:
    """16 lower-case digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


#: Similar documents: words of a shingle, least similarity in per cent, bits of a fingerprint.
SIMILAR_WORDS, SIMILAR_PERCENT, WIDE = 5, 80, 128
#: Bits that differ between fingerprints of similar texts at most: 2.6 deviations above what a similarity of 0.8 gives.
WIDE_RADIUS = 30
#: Share of bits in which a similarity of 0.8 agrees; wanted recall of the files; fingerprints a file should hold.
AGREE, RECALL, FILE_SIZE = 0.8485, 0.98, 512


def wide_prints(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), words: int = SIMILAR_WORDS) -> DataFrame:
    """key, keep, n, s1 and s2 (which stand for the set of distinct shingles), p and q (its 128-bit fingerprint; 0 for an empty set)."""
    names = [key, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def compute(batches):
        for batch in batches:
            out = np.zeros((5, batch.num_rows), np.int64)
            for first, data, borders in T.runs(batch.column("_text")):
                texts = len(borders) - 1
                found, owners = sets_of.shingle_sets(data, borders, words)
                size, s1, s2 = sets_of._sums(found, owners, texts)
                at = first + np.arange(texts)
                out[0, at], out[1, at], out[2, at] = size, s1, s2
                filled = np.flatnonzero(size)
                if len(filled):
                    starts = (np.cumsum(size) - size)[filled]
                    for row, salt in ((3, 0x2545F4914F6CDD1D), (4, 0x9FB21C651E98DF25)):
                        bits = np.unpackbits(T.mix(found ^ np.uint64(salt)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
                        out[row, first + filled] = np.packbits(2 * ones > size[filled][:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, out)], [*names, "n", "s1", "s2", "p", "q"])

    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(compute, f"{kinds}, n long, s1 long, s2 long, p long, q long")


def within_radius(planes: np.ndarray, rows: int, queries: np.ndarray, radius: int) -> np.ndarray:
    """(queries, rows): whether fingerprints differ in at most `radius` bits; queries are (n, words of 64 bits).

    Carry-save counters start so that they run over at radius + 1; a block is left as soon as all of its counters have.
    """
    shape, levels = (len(queries), planes.shape[1]), max(1, radius.bit_length())
    counters = [np.full(shape, ALL if ((1 << levels) - 1 - radius) >> k & 1 else 0, np.uint64) for k in range(levels)]
    over = np.zeros(shape, np.uint64)
    if rows % 64:
        over[:, -1] = ALL << np.uint64(rows % 64)
    for p in range(len(planes)):
        bit = (queries[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
        carry = planes[p] ^ np.where(bit, ALL, np.uint64(0))[:, None]
        for k in range(levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 7 and (over == ALL).all():
            break
    return np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :rows].astype(bool)


def _near(table: pa.Table, percent: int, radius: int):
    """(x, ys) of the rows of a file's part or pair of parts whose sizes and fingerprints are near."""
    n, part, p, q = (table.column(c).to_numpy() for c in ("n", "part", "p", "q"))
    i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
    prints = np.stack([p, q], 1).view(np.uint64)
    planes = np.concatenate([planes_of(prints[:, 0].copy()), planes_of(prints[:, 1].copy())])
    for begin in range(0, len(n), 256):
        near = within_radius(planes, len(n), prints[begin : begin + 256], radius)
        for x in np.flatnonzero(near.sum(1) > 1):
            y = np.flatnonzero(near[x])
            x = begin + int(x)
            y = y[(y != x) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
            y = y if i == j else y[part[y] != part[x]]
            if len(y):
                yield x, y


def files_for(prints: int, agree: float = AGREE, recall: float = RECALL, size: int = FILE_SIZE) -> list[np.ndarray]:
    """The places of the sampled bits of every repetition: so many bits that a file holds about `size` fingerprints, and so
    many repetitions that similar ones meet in a file with a chance of `recall`."""
    bits = max(4, int(np.ceil(np.log2(max(1, prints / size)))))
    repeats = int(np.ceil(np.log(1 - recall) / np.log(1 - agree**bits)))
    rng = np.random.default_rng(17)
    return [np.sort(rng.permutation(WIDE)[:bits]) for _ in range(repeats)]


def similar_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), percent: int = SIMILAR_PERCENT,
    words: int = SIMILAR_WORDS, radius: int = WIDE_RADIUS,
) -> DataFrame:
    """key, `keep` and root (a long) of every row; rows with equal root are connected by texts of similarity `percent` or more.

    Fingerprints of distinct shingle sets are filed by sampled bits; in each file, bit-sliced comparison proposes for every
    fingerprint the one with most neighbours among those within `radius`. These pairs are confirmed on the full sets. Then the
    files compare what is near but not yet connected, and confirm it there. Texts without words are one group. Repeated
    rows and null keys are rows like any other; an empty table gives no rows.
    """
    # Columns of docs take names of their own, so that they can be called anything.
    given = [key, *keep]
    own = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(given)], F.col(f"`{text}`").alias("_t"))
    names = [f"_{i}" for i in range(len(given))]
    rows = stage(wide_prints(own, "_0", "_t", tuple(names[1:]), words)).withColumn("row", F.monotonically_increasing_id())
    of_set = ["n", "s1", "s2"]
    classes = stage(rows.groupBy(*of_set).agg(F.min("row").alias("c"), F.first("p").alias("p"), F.first("q").alias("q")))
    filled = classes.where("n > 0")
    masks = []
    for places in files_for(filled.count()):
        low, high = (int(sum(1 << int(b) % 64 for b in places if b // 64 == half)) for half in (0, 1))
        masks.append([m - (1 << 64) if m >> 63 else m for m in (low, high)])
    files = [F.xxhash64(F.lit(t), F.col("p").bitwiseAND(F.lit(a)), F.col("q").bitwiseAND(F.lit(b))) for t, (a, b) in enumerate(masks)]
    filed = filled.select("c", "n", "p", "q", F.explode(F.array(*files)).alias("bucket"))

    def busiest(table: pa.Table) -> pa.Table:
        c = table.column("c").to_numpy()
        near = dict(_near(table, percent, radius))
        degree = np.zeros(len(c), np.int64)
        for x, ys in near.items():
            degree[x] = len(ys)
        best = {x: ys[np.lexsort((c[ys], -degree[ys]))[0]] for x, ys in near.items()}
        at, to = np.array(list(best), np.int64), np.array(list(best.values()), np.int64)
        return pa.table({"c": pa.array(c[at]), "hub": pa.array(c[to]), "degree": pa.array(degree[to])})

    shape = "c long, hub long, degree long"
    proposed = stage(sets_of.in_parts(filed, few_large=False).groupBy(*sets_of.CELL).applyInArrow(busiest, shape))
    best = proposed.groupBy("c").agg(F.max_by("hub", F.struct("degree", (-F.col("hub")).alias("least"))).alias("hub"))
    met = stage(proposed.select("c").union(proposed.select(F.col("hub").alias("c"))).distinct())
    wanted = stage(filled.join(met, "c", "left_semi").select(*of_set, "c", "p", "q"))
    few = F.broadcast(wanted.select(*of_set, "c")) if wanted.count() <= sets_of.SMALL else wanted.select(*of_set, "c")
    sets = stage(sets_of.full_sets(docs, text, words).join(few, of_set).groupBy("c").agg(F.first("elements").alias("elements")))
    links = stage(sets_of.confirmed(best.select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct(), sets, percent))
    again = wanted.select("c", "n", "p", "q", F.explode(F.array(*files)).alias("bucket"))
    open_ = sets_of.in_parts(sets_of.unsettled(stage(sets_of.with_component(again, links))))

    def apart(table: pa.Table):
        label = table.column("label").to_numpy()
        for x, ys in _near(table, percent, radius):
            ys = ys[(label[ys] != label[x]) & (ys > x)]
            if len(ys):
                yield x, ys

    links = links.union(sets_of.across_components(open_, sets, percent, apart))
    roots = connected_components(links)
    found = classes.join(roots, classes["c"] == roots["node"], "left").select(*of_set, F.coalesce("root", "c").alias("root"))
    joined = join_small(rows.select(*names, *of_set), found, of_set, "inner")
    return joined.select(*[F.col(n).alias(c) for n, c in zip(names, given)], "root")
