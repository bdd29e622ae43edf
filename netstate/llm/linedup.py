"""Repeated line runs by a distributed suffix array over line numbers; later copies are deleted.

Every text is a sequence of its non-blank lines. Suffixes are sorted by prefix doubling: ranks of runs of one line, two,
four and so on, where the rank of a run of 2h lines is the place of the pair (rank of the first h, rank of the next h) in
sorted order. Suffixes with equal ranks form an interval of the suffix array with a common prefix of that many lines.
A maximal repeated run of at least `least_words` words is the union of its shortest sub-runs with so many words, each
taken from its start or from its end; such a sub-run of n lines is named by the ranks of its first and its last 2**k
lines, with 2**k the greatest power in n. Hence doubling may end at the longest sub-run, which has `least_words` lines at
most. Runs that occur once are dropped at every step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netstate.llm import text as T
from netstate.scale import stage

LEAST_WORDS = 50


def text_lines(docs: DataFrame, key: str, text: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per non-blank line: id, th (hash of the text), pos (number among these lines), no (line number), hi, lo (hash
    of the line without white space at its ends), ahead and back (lines of the shortest run of enough words that starts or ends here; 0: none)
    and reach (no needed run that covers this line and starts here is longer)."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "th", "pos", "no", "hi", "lo", "ahead", "back", "reach"]

    def split(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            rows, pos, no, digests, ahead, back, reach = [], [], [], [], [], [], []
            for first, data, borders in T.runs(batch.column("t")):
                content = data.tobytes()
                for i in range(len(borders) - 1):
                    kept = [(j, s) for j, s in enumerate(x.strip() for x in content[borders[i] : borders[i + 1]].split(b"\n")) if s]
                    if not kept:
                        continue
                    n = len(kept)
                    ends = np.cumsum([len(s.split()) for _, s in kept])
                    begins = np.concatenate([[0], ends[:-1]])
                    to = np.searchsorted(ends, begins + least_words)
                    since = np.searchsorted(begins, ends - least_words, "right") - 1
                    here = np.arange(n)
                    rows.append(np.full(n, first + i))
                    pos.append(here)
                    no.append(np.array([j for j, _ in kept]))
                    digests += [digest(s) for _, s in kept]
                    ahead.append(np.where(to < n, to - here + 1, 0))
                    back.append(np.where(since >= 0, here - since + 1, 0))
                    reach.append(np.searchsorted(ends, ends + least_words) - here + 1)
                if sum(map(len, rows)) > 100_000:
                    yield made(batch, rows, pos, no, digests, ahead, back, reach)
                    rows, pos, no, digests, ahead, back, reach = [], [], [], [], [], [], []
            if rows:
                yield made(batch, rows, pos, no, digests, ahead, back, reach)

    def made(batch, rows, pos, no, digests, ahead, back, reach):
        at = pa.array(np.concatenate(rows))
        hashes = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        number = lambda parts: pa.array(np.concatenate(parts).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(at), batch.column("th").take(at), number(pos), number(no), pa.array(hashes[:, 0].copy()),
             pa.array(hashes[:, 1].copy()), number(ahead), number(back), number(reach)], names,
        )

    wanted = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    schema = f"id {kind}, th long, pos int, no int, hi long, lo long, ahead int, back int, reach int"
    return wanted.mapInArrow(split, schema)


def ranked(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(first, second, rank) of the pairs that occur more than once; ranks follow the sorted order of the pairs."""
    pairs = rows.groupBy(first, second).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(first, second)
    ordered = pairs.repartitionByRange(first, second).sortWithinPartitions(first, second)
    return stage(ordered.withColumn("rank", F.monotonically_increasing_id()))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, th, lines): for each text with lines to delete, their numbers. Texts are known by key and hash (th).

    Copies are ordered by key (null last), hash and line. A run that overlaps its first copy loses only what lies beyond
    that copy. Rows equal in key and text count as one text.
    """
    lines = stage(text_lines(docs, key, text, least_words))
    doc = Window.partitionBy("id", "th").orderBy("pos")
    level, rows = 0, lines.join(ranked(lines, "hi", "lo"), ["hi", "lo"]).drop("hi", "lo").distinct()
    windows, single = [], None
    while True:
        rows = stage(rows)
        single = rows if single is None else single
        span = 1 << level
        # A run that starts here, and the ranks of its first and last lines; then the same for runs that end here.
        ranks = rows.select(F.col("id").alias("i2"), F.col("th").alias("t2"), F.col("pos").alias("p2"), F.col("rank").alias("r2"))
        sized = lambda n: (F.col(n) >= span) & (F.col(n) < 2 * span)
        starting = rows.where(sized("ahead")).select("id", "th", F.col("pos").alias("start"), F.col("ahead").alias("n"), F.col("rank").alias("r1"))
        tail = (F.col("i2").eqNullSafe(F.col("id"))) & (F.col("t2") == F.col("th")) & (F.col("p2") == F.col("start") + F.col("n") - span)
        windows.append(starting.join(ranks, tail).select("id", "th", "start", "n", "r1", "r2"))
        ends_here = single.where(sized("back")).select("id", "th", (F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("n"))
        heads = rows.select(F.col("id").alias("i1"), F.col("th").alias("t1"), F.col("pos").alias("p1"), F.col("rank").alias("r1"))
        head = (F.col("i1").eqNullSafe(F.col("id"))) & (F.col("t1") == F.col("th")) & (F.col("p1") == F.col("start"))
        windows.append(ends_here.join(heads, head).join(ranks, tail).select("id", "th", "start", "n", "r1", "r2"))
        if 2 * span > least_words:
            break
        after = F.first("rank").over(doc.rangeBetween(span, span))
        pairs = rows.withColumn("after", after).where((F.col("reach") >= 2 * span) & F.col("after").isNotNull())
        pairs = pairs.withColumnRenamed("rank", "before")
        ranks = ranked(pairs, "before", "after")
        if ranks.isEmpty():
            break
        rows, level = pairs.join(ranks, ["before", "after"]).drop("before", "after"), level + 1
    found = windows[0]
    for more in windows[1:]:
        found = found.union(more)
    found = stage(found.distinct())
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th", "start")
    first = found.groupBy("n", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = found.join(first.drop("copies"), ["n", "r1", "r2"]).where(place != F.col("first"))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    start = F.when(own, F.greatest(F.col("start"), F.col("first.start") + F.col("n"))).otherwise(F.col("start"))
    gone = later.select("id", "th", F.explode(F.sequence(start, F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    numbers = lines.select("id", "th", "pos", "no").distinct().alias("l")
    gone = gone.alias("g")
    same = F.col("g.id").eqNullSafe(F.col("l.id")) & (F.col("g.th") == F.col("l.th")) & (F.col("g.pos") == F.col("l.pos"))
    return gone.join(numbers, same).select("g.id", "g.th", "l.no").groupBy("id", "th").agg(F.sort_array(F.collect_set("no")).alias("lines"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with later copies of repeated line runs deleted from the text, and n_deleted, the number of deleted lines.

    A run counts from `least_words` words. A text that loses all its lines that are not blank is dropped; texts without a
    repeated run, null and empty ones among them, stay as they are. A column of docs named n_deleted is replaced; others may have any name.
    """
    docs = docs.drop("n_deleted")
    gone = repeated_lines(docs, key, text, least_words).alias("g")
    own = docs.alias("d")
    same = F.xxhash64(F.col(f"d.`{text}`")).eqNullSafe(F.col("g.th")) & F.col(f"d.`{key}`").eqNullSafe(F.col("g.id"))
    held = "_lines"
    while held in docs.columns:
        held += "_"
    # Lines are split once, and the numbers that stay come of one hashed pass, so that time grows with the lines.
    split = F.when(F.col("g.lines").isNotNull(), F.split(F.col(f"d.`{text}`"), "\n", -1))
    joined = own.join(gone, same, "left").withColumn(held, split)
    stay = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.transform("g.lines", lambda i: i.cast("int")))
    kept = F.transform(stay, lambda i: F.get(F.col(held), i))
    new = F.when(F.col("g.lines").isNull(), F.col(f"d.`{text}`")).otherwise(F.array_join(kept, "\n"))
    columns = [new.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    cut = joined.select(*columns, F.coalesce(F.size("g.lines"), F.lit(0)).alias("n_deleted"))
    return cut.where((F.col("n_deleted") == 0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
