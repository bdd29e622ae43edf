"""Near-duplicates by SuperMinHash signatures: banding, verification on full shingle sets, union of the links.

An element's ranks for all slots of a signature form one random permutation, so that its first slots are spread evenly
and the signature varies less than with independent hashes. Slot values are rank + fraction; a document is done as soon as
no slot can be lowered by the next rank, after few ranks for all but the shortest texts. Signatures are cut into bands;
documents that agree in a band share a bucket. Buckets only propose pairs: every link is confirmed on the full sets.

A bucket's pairs are not listed. First each member is compared with the busiest member of its buckets, which ties a group of
copies together with one comparison each; members of buckets that still hold several components are compared with further
single members. Where components are left, the signatures of a bucket's members are compared across them in vectorised
steps, and the pairs that agree in enough slots are confirmed in the bucket. So no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.llm import text as T
from netstate.llm.components import connected_components
from netstate.scale import join_small, stage

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair of similarity 0.85 shares no band with a chance of 8e-7.
BANDS = 24
ROWS = 5
#: Elements whose permutations are held at a time.
PIECE = 1 << 17
#: Rounds that compare each member with a single one of its buckets, before signatures are compared across components.
STAR_ROUNDS = 2
#: Slots that a pair must agree in to be confirmed on the full sets: 5.5 deviations below what a similarity of 0.85 gives.
LEAST_SLOTS = 85
#: Members of a bucket that are compared at a time; larger buckets are dealt into parts whose pairs are tasks.
PART = 1024
#: Sets of each side that a confirming task holds on average.
CELL_SETS = 2000
#: Pairs or classes up to this number are sent to every task.
SMALL = 50_000
_FRACTION = np.uint64((1 << 24) - 1)


def shingle_sets(data: np.ndarray, borders: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of the distinct shingles of every text of a run, by text.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    data = T.LOWER[data]
    starts, ends, owner = T.spans(data, borders, T.NOT_SPACE)
    single = T.span_hashes(data, starts, ends)
    rolled = single
    for k in range(1, words):
        rolled = T.pair(rolled[: max(0, len(single) - k)], single[k:])
    inside = owner[words - 1 :] == owner[: len(rolled)]
    found, owners = rolled[inside], owner[: len(rolled)][inside]
    count = np.bincount(owner, minlength=len(borders) - 1)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = single[first[short]]
        for k in range(1, words - 1):
            more = count[short] > k
            whole = np.where(more, T.pair(whole, single[np.where(more, first[short] + k, 0)]), whole)
        found = np.concatenate([found, T.pair(whole, count[short].astype(np.uint64))])
        owners = np.concatenate([owners, short])
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])
    return found[new], owners[new]


def signatures(found: np.ndarray, owners: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """(texts, slots) signature values: rank in the high bits, 24 bits of fraction; all ones for a text without elements.

    slots must be below 256. The elements of a text are processed in pieces; a later piece starts from the values so far.
    """
    values = np.full(texts * slots, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(found), PIECE):
        own, text = found[begin : begin + PIECE], owners[begin : begin + PIECE]
        order = np.empty((len(own), slots), np.uint8)
        order[:] = np.arange(slots, dtype=np.uint8)
        active = np.arange(len(own))
        low, high = int(text[0]), int(text[-1]) + 1
        for rank in range(slots):
            drawn = T.mix(own[active] + np.uint64(rank * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            swap = rank + ((drawn >> np.uint64(32)) % np.uint64(slots - rank)).astype(np.int64)
            slot = order[active, swap]
            order[active, swap] = order[active, rank]
            value = (drawn & _FRACTION).astype(np.uint32) | np.uint32(rank << 24)
            np.minimum.at(values, text[active] * slots + slot, value)
            worst = values[low * slots : high * slots].reshape(-1, slots).max(1)
            open_ = worst >= np.uint32(min(rank + 1, 255) << 24)
            active = active[open_[text[active] - low]]
            if not len(active):
                break
    return values.reshape(texts, slots)


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) bucket numbers; different bands have different buckets."""
    cut = values.reshape(len(values), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), cut.shape[:2]).copy()
    for k in range(rows):
        out = T.pair(out, cut[:, :, k])
    return out.view(np.int64)


def _sums(found: np.ndarray, owners: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit sums of scrambled hashes of each text's set: together they stand for the set."""
    size = np.bincount(owners, minlength=texts)
    out = []
    for salt in (0, 0xA0761D6478BD642F):
        total = np.zeros(len(found) + 1, np.uint64)
        np.cumsum(T.mix(found ^ np.uint64(salt)), out=total[1:])
        end = np.cumsum(size)
        out.append((total[end] - total[end - size]).view(np.int64))
    return size, *out


def sign_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """key, n (size of the shingle set), s1 and s2 (sums that stand for the set), bands (its buckets) and slots (a byte for each slot)."""
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, parts = batch.num_rows, []
            for _, data, borders in T.runs(batch.column("_text")):
                texts = len(borders) - 1
                found, owners = shingle_sets(data, borders, words)
                values = signatures(found, owners, texts, bands * rows)
                short = (T.mix(values.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                parts.append((*_sums(found, owners, texts), band_hashes(values, bands, rows), short))
            size, s1, s2, buckets, short = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
            kept = buckets[size > 0].reshape(-1) if n else buckets
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(kept, pa.int64()))
            slots = pa.array([row.tobytes() if filled else None for row, filled in zip(short, size)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in (size, s1, s2)], listed, slots], [key, "n", "s1", "s2", "bands", "slots"]
            )

    return docs.select(key, F.col(text).alias("_text")).mapInArrow(sign, f"`{key}` {kind}, n long, s1 long, s2 long, bands array<long>, slots binary")


def full_sets(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """n, s1, s2 and elements of each text's set; a set that a task meets again is left out."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            for _, data, borders in T.runs(batch.column("_text")):
                texts = len(borders) - 1
                found, owners = shingle_sets(data, borders, words)
                size, s1, s2 = _sums(found, owners, texts)
                end = np.cumsum(size)
                new = []
                for i, mark in enumerate(zip(size.tolist(), s1.tolist(), s2.tolist())):
                    if mark[0] and mark not in seen:
                        seen.add(mark)
                        new.append(i)
                elements = pa.array([found[end[i] - size[i] : end[i]].view(np.int64) for i in new], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.array(c[new], pa.int64()) for c in (size, s1, s2)], elements], ["n", "s1", "s2", "elements"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(gather, "n long, s1 long, s2 long, elements array<long>")


def similar_size(a: str, b: str, percent: int = PERCENT) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _common(one: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    short, long = sorted((one, other), key=len)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    return int((long[at] == short).sum())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Pairs are dealt into cells by hashes of both sides; a set goes once to each cell that needs it, however many pairs it is in.
    """
    pairs = stage(pairs)
    sides = max(8, -(-sets.count() // CELL_SETS))
    near, far = (F.pmod(F.xxhash64(c), F.lit(sides)).cast("int").alias(name) for c, name in (("a", "near"), ("b", "far")))
    celled = pairs.select("a", "b", near, far)
    needed = celled.select(F.col("a").alias("c"), "near", "far").union(celled.select(F.col("b").alias("c"), "near", "far")).distinct()
    needed = stage(needed)
    sent = sets.join(F.broadcast(needed) if needed.count() <= SMALL else needed, "c").select("c", "near", "far", "elements")

    def confirm(left: pa.Table, right: pa.Table) -> pa.Table:
        elements = right.column("elements").combine_chunks()
        values, borders = elements.values.to_numpy(), elements.offsets.to_numpy()
        own = {c: np.sort(values[borders[i] : borders[i + 1]]) for i, c in enumerate(right.column("c").to_pylist())}
        keep = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            common = _common(own[a], own[b])
            keep.append(100 * common >= percent * (len(own[a]) + len(own[b]) - common))
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return celled.groupBy("near", "far").cogroup(sent.groupBy("near", "far")).applyInArrow(confirm, "a long, b long")


def _candidates(table: pa.Table, percent: int, least: int):
    """(x, ys) of the rows of a bucket's part or pair of parts that sizes and signatures allow to be linked.

    A pair that shares several buckets comes up in its first common band alone.
    """
    c, n, label, part = (table.column(x).to_numpy() for x in ("c", "n", "label", "part"))
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(c), -1)
    slots = np.frombuffer(b"".join(table.column("slots").to_pylist()), np.uint8).reshape(len(c), -1)
    bucket, i, j = (table.column(x)[0].as_py() for x in ("bucket", "i", "j"))
    for x in range(len(c)):
        # Within one part each pair once; between two parts only pairs of both.
        y = np.arange(x + 1, len(c)) if i == j else np.flatnonzero(part != part[x]) if part[x] == i else np.zeros(0, np.int64)
        y = y[(label[y] != label[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
        y = y[(slots[y] == slots[x]).sum(1) >= least]
        if len(y):
            y = y[bands[x][(bands[y] == bands[x]).argmax(1)] == bucket]
        if len(y):
            yield x, y


CELL = ["bucket", "i", "j"]


def in_parts(members: DataFrame, few_large: bool = True) -> DataFrame:
    """members with part, i and j: buckets of more than 2 * PART rows are dealt into parts, whose pairs (i, j) are tasks.

    Only large buckets' sizes are looked up, or all of them where buckets are few against their rows (`few_large` false).
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    found = members.join(sizes.where(F.col("size") > 2 * PART), "bucket", "left") if few_large else members.join(sizes, "bucket")
    large = F.coalesce(F.col("size") > 2 * PART, F.lit(False))
    dealt = found.withColumn("parts", F.when(large, F.ceil(F.col("size") / F.lit(PART))).otherwise(F.lit(1)).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*members.columns, "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def across_components(dealt: DataFrame, sets: DataFrame, percent: int, find) -> DataFrame:
    """Links (a, b) that connect all similar members of a bucket which are in different components.

    dealt holds bucket, i, j, c, label and what `find` reads, which yields (x, ys) of rows that may be linked. First it names
    the members that have someone to be compared with; then only these bring their sets to the bucket, which returns a link
    for every two components it joins, not every pair.
    """
    cell = CELL
    dealt = stage(dealt)

    def named(table: pa.Table) -> pa.Table:
        wanted = np.zeros(table.num_rows, bool)
        for x, ys in find(table):
            wanted[x] = True
            wanted[ys] = True
        return table.select([*cell, "c"]).filter(pa.array(wanted))

    def confirm(table: pa.Table) -> pa.Table:
        c, labels = table.column("c").to_pylist(), table.column("label").to_pylist()
        elements = table.column("elements").combine_chunks()
        values, borders = elements.values.to_numpy(), elements.offsets.to_numpy()
        own = [np.sort(values[borders[k] : borders[k + 1]]) for k in range(len(c))]
        parent: dict[int, int] = {}
        links = []

        def top(label: int) -> int:
            while parent.get(label, label) != label:
                label = parent[label]
            return label

        for x, ys in find(table):
            for y in ys.tolist():
                one, other = top(labels[x]), top(labels[y])
                if one == other:
                    continue
                common = _common(own[x], own[y])
                if 100 * common >= percent * (len(own[x]) + len(own[y]) - common):
                    parent[max(one, other)] = min(one, other)
                    links.append((c[x], c[y]))
        both = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    wanted = dealt.groupBy(*cell).applyInArrow(named, "bucket long, i int, j int, c long")
    brought = dealt.join(stage(wanted), [*cell, "c"]).join(sets, "c")
    return brought.groupBy(*cell).applyInArrow(confirm, "a long, b long")


def with_component(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with label: the root of their component, or themselves."""
    roots = connected_components(links)
    return members.join(roots, members["c"] == roots["node"], "left").select(*members.columns, F.coalesce("root", "c").alias("label"))


def unsettled(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    buckets = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return members.join(buckets.select("bucket"), "bucket", "left_semi")


def similar_links(
    members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS, least: int = LEAST_SLOTS
) -> DataFrame:
    """Links (a, b) that connect all similar pairs of classes which share a bucket; members are (bucket, c, n, degree)."""
    open_, links = members.withColumn("label", F.col("c")), None
    for number in range(star_rounds):
        # Each class with one member of its buckets: first the busiest, ties go to the least class; then any.
        by = F.col("degree") if number == 0 else F.xxhash64(F.lit(number), "c")
        hub = F.struct(by.alias("by"), (-F.col("c")).alias("minus"), "c", "n", "label")
        hubs = open_.groupBy("bucket").agg(F.max(hub).alias("hub"))
        other = open_.join(hubs, "bucket").where((F.col("hub.label") != F.col("label")) & similar_size("n", "hub.n", percent))
        best = other.groupBy("c").agg(F.max("hub").alias("hub"))
        found = confirmed(best.select(F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b")).distinct(), sets, percent)
        links = stage(found if links is None else links.union(found))
        open_ = stage(unsettled(with_component(members, links)))
        if open_.isEmpty():
            return links
    dealt = in_parts(open_.select("bucket", "c", "n", "label")).join(classes.select("c", "bands", "slots"), "c")
    return stage(links.union(across_components(dealt, sets, percent, lambda table: _candidates(table, percent, least))))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, words: int = WORDS
) -> DataFrame:
    """key, n_shingles, component_id and kept of every row.

    Words are runs of other characters than ASCII white space after lower-casing A-Z; a text's set holds its distinct
    shingles, or all its words as one if they are fewer. Texts whose sets have ``100 * intersection >= percent * union`` are
    linked; component_id is the least key that links lead to, and kept says whether it is the row's own. A null text, or one
    without words, is linked with nothing. Rows without key have no part in the least key; their component_id is null
    only if nobody in the component has one, and then they are kept. Repeated rows get repeated results. An empty table
    gives no rows. Only the key and the text are read.
    """
    signed = stage(sign_texts(docs, key, text, bands, rows, words)).withColumn("row", F.monotonically_increasing_id())
    of_set = ["n", "s1", "s2"]
    classes = stage(
        signed.where("n > 0").groupBy(*of_set).agg(F.min("row").alias("c"), F.min(key).alias("least"), F.first("bands").alias("bands"), F.first("slots").alias("slots"))
    )
    filed = classes.select("c", "n", F.explode("bands").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(filed.join(shared, "bucket"))
    busy = members.groupBy("c").agg(F.sum("size").alias("degree"))
    members = stage(members.drop("size").join(busy, "c"))
    proposed = stage(classes.join(busy, "c", "left_semi").select(*of_set, "c"))
    if proposed.count() <= SMALL:
        proposed = F.broadcast(proposed)
    sets = full_sets(docs, text, words).join(proposed, of_set).groupBy("c").agg(F.first("elements").alias("elements"))
    least = LEAST_SLOTS if (bands * rows, percent) == (BANDS * ROWS, PERCENT) else 0
    links = similar_links(members, classes, stage(sets), percent, least=least)
    roots = connected_components(links)
    joined = classes.join(roots, classes["c"] == roots["node"], "left").select(*of_set, "least", F.coalesce("root", "c").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    found = joined.join(lowest, "root").select(*of_set, "component_id")
    own = signed.select(key, *of_set)
    linked = join_small(own.where("n > 0"), found, of_set, "inner")
    alone = own.where("n = 0").withColumn("component_id", F.col(key))
    both = linked.select(key, "n", "component_id").unionByName(alone.select(key, "n", "component_id"))
    return both.select(key, F.col("n").alias("n_shingles"), "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))
