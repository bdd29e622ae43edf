"""Alignment of two tokenizers over whole texts, with corpus-wide counts of linked token pairs by external merging.

Both tokenizers cut the same bytes. Byte offsets where tokens of both end cut a text into groups; two tokens are linked
where their bytes overlap. Texts are taken in blocks of about a megabyte. A block's pair-document records are sorted by
(radix of the first tokenizer's id, that id, the other id) and compressed with zstd. Only its distinct pairs, with the
number of the block's documents that hold each, leave it: one sorted run for each radix. A radix is merged by one task,
which keeps the runs compressed, on disk beyond SPILL_BYTES, and reads them frame by frame through a heap. In this order all
pairs of a first id come together, so their counts and the highest of them are known at once, and go back to the
runs they came from. A pair that every document holds is one entry per block.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import merge
from itertools import groupby
from operator import itemgetter
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm import text as T
from netstate.scale import stage

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how byte-level tokenizers of this kind cut a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text in a block, pairs in a frame of a run, bytes of runs or results a merging task holds in memory.
BLOCK_BYTES = 1 << 20
FRAME = 4096
SPILL_BYTES = 64 << 20
#: Least and greatest number of radices; in between there is one for each partition of the texts.
LEAST_RADICES, MOST_RADICES = 32, 4096
_LOW = np.uint64(0xFFFFFFFF)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Tokenizer:
    """ids of texts, the bytes of every id, and whether tokens' bytes always are those of the text."""

    encode: object
    pieces: list[bytes]
    lossless: bool = False
    lengths: np.ndarray = field(init=False)

    def __post_init__(self):
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)


@lru_cache(maxsize=4)
def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE from a JSON file; texts get a space in front.

    Where ids follow the order of the merges, the ids are merge ranks and a rank encoder gives the same ids several times
    faster; any other file is used as it is.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, alphabet = content["model"], byte_alphabet()
    size = max(model["vocab"].values()) + 1
    pieces = [b""] * size
    for token, number in model["vocab"].items():
        pieces[number] = bytes(alphabet[c] for c in token)
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    ranked = merged == list(range(256, 256 + len(merged))) and content.get("normalizer") is None
    if ranked and content["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        import tiktoken

        ranks = {p: i for i, p in enumerate(pieces) if p}
        encoder = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return Tokenizer(lambda texts: [encoder.encode_ordinary(" " + t) for t in texts], pieces, lossless=True)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer as FromFile

    own = FromFile.from_file(path)
    own.encode_special_tokens = True
    return Tokenizer(lambda texts: [e.ids for e in own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], pieces)


@lru_cache(maxsize=4)
def piece_level(path: str) -> Tokenizer:
    """A sentence-piece model, which puts a space in front by itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for number in range(own.get_piece_size()):
        piece = own.id_to_piece(number)
        pieces.append(bytes([int(piece[3:5], 16)]) if own.is_byte(number) else piece.replace("▁", " ").encode("utf-8"))
    return Tokenizer(lambda texts: own.encode(texts, num_threads=1), pieces)


@dataclass
class Aligned:
    """Token ids of a block's documents, and their links as places in these ids."""

    a: np.ndarray
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_doc: np.ndarray


def align_texts(texts: list[str | None], first: Tokenizer, second: Tokenizer) -> Aligned:
    """Groups and links of texts. A text whose tokens' bytes are not a space and the text has no tokens."""
    places = [i for i, t in enumerate(texts) if t]
    filled = [texts[i] for i in places]
    both = zip(places, filled, first.encode(filled) if filled else [], second.encode(filled) if filled else [])
    none = np.zeros(0, np.int64)
    ids: tuple[list, list] = ([none], [none])
    docs: list[int] = []
    for place, text, a, b in both:
        whole = b" " + text.encode("utf-8")
        if all(t.lossless or b"".join(map(t.pieces.__getitem__, own)) == whole for t, own in ((first, a), (second, b))):
            ids[0].append(np.frombuffer(array("q", a), np.int64))
            ids[1].append(np.frombuffer(array("q", b), np.int64))
            docs.append(place)
    a, b = np.concatenate(ids[0]), np.concatenate(ids[1])
    number = np.array(docs, np.int64)
    a_doc = np.repeat(number, [len(x) for x in ids[0][1:]])
    b_doc = np.repeat(number, [len(x) for x in ids[1][1:]])
    # Valid texts are cut into the same bytes, so offsets run on over the block; a mark stands where a token ends.
    a_end, b_end = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
    marks = np.zeros((2, int(a_end[-1]) + 1 if len(a) else 1), bool)
    marks[0, a_end], marks[1, b_end] = True, True
    shared = marks[0] & marks[1]
    before = lambda at: np.cumsum(at, dtype=np.int32) - at
    group, a_number, b_number = before(shared), before(marks[0]), before(marks[1])
    cell = np.flatnonzero(marks[0] | marks[1])
    group_doc = a_doc[a_number[shared]]
    return Aligned(a, b, a_doc, b_doc, group[a_end], group[b_end], a_number[cell], b_number[cell], group_doc)


@lru_cache(maxsize=8)
def _printed(size: int, end: str) -> np.ndarray:
    return np.array([f"{i}{end}" for i in range(size)], object)


def group_texts(aligned: Aligned, texts: int) -> list[str]:
    """For each document its groups: ids of the first tokenizer, a bar, ids of the second; groups are cut by semicolons."""
    size = 1 + int(max(aligned.a.max(initial=0), aligned.b.max(initial=0)))
    size = 1 << (size - 1).bit_length()
    parts = np.empty(len(aligned.a) + len(aligned.b), object)
    last_a = np.append(aligned.a_group[1:] != aligned.a_group[:-1], True)[: len(aligned.a)]
    last_b = np.append(aligned.b_group[1:] != aligned.b_group[:-1], True)[: len(aligned.b)]
    # A token stands after all tokens of earlier groups, the second tokenizer's after the first's of their group too.
    at_a = np.arange(len(aligned.a)) + np.searchsorted(aligned.b_group, aligned.a_group)
    at_b = np.arange(len(aligned.b)) + np.searchsorted(aligned.a_group, aligned.b_group, "right")
    parts[at_a] = np.where(last_a, _printed(size, "|")[aligned.a], _printed(size, ",")[aligned.a])
    parts[at_b] = np.where(last_b, _printed(size, ";")[aligned.b], _printed(size, ",")[aligned.b])
    sizes = np.bincount(aligned.a_doc, minlength=texts) + np.bincount(aligned.b_doc, minlength=texts)
    ends = np.cumsum(sizes).tolist()
    listed = parts.tolist()
    return ["".join(listed[e - s : e])[:-1] for s, e in zip(sizes.tolist(), ends)]


def packed(*columns: np.ndarray) -> bytes:
    """Integer columns of equal length, their bytes of equal weight together, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    rows, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + rows * size].reshape(size, rows).T).view(kind).reshape(rows))
        at += rows * size
    return out


def write_run(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run as frames of a length and compressed differences and counts."""
    out = []
    for i in range(0, len(pairs), FRAME):
        part = pairs[i : i + FRAME]
        frame = packed(np.diff(part, prepend=np.uint64(0)), counts[i : i + FRAME].astype(np.uint32))
        out += [struct.pack("<I", len(frame)), frame]
    return b"".join(out)


def sides(file: BinaryIO, begin: int, end: int, run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first id, run, second ids, counts) of a run in a file, one frame in memory at a time."""
    held: tuple[np.ndarray, np.ndarray] | None = None
    while begin < end:
        file.seek(begin)
        size = struct.unpack("<I", file.read(4))[0]
        steps, counts = unpacked(file.read(size), np.uint64, np.uint32)
        begin += 4 + size
        pairs = np.cumsum(steps, dtype=np.uint64)
        if held is not None:
            pairs, counts = np.concatenate([held[0], pairs]), np.concatenate([held[1], counts])
        first = (pairs >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(first[1:] != first[:-1]) + 1
        # The last side may go on in the next frame.
        cuts = [0, *edges.tolist(), len(pairs)]
        last = len(cuts) - 2 if begin < end else len(cuts) - 1
        second = (pairs & _LOW).astype(np.int64)
        heads = first[cuts[:-1]].tolist()
        for k in range(last):
            yield heads[k], run, second[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]
        held = (pairs[cuts[last] :], counts[cuts[last] :]) if begin < end else None


def merged(file: BinaryIO, spans: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[int], list[np.ndarray]]]:
    """(first id, second ids, documents, runs, places) by first id: how many documents hold each pair, and for each run that
    holds the first id the places of its pairs among the second ids."""
    heap = merge(*[sides(file, a, b, run) for run, (a, b) in enumerate(spans)], key=itemgetter(0))
    for first, part in groupby(heap, key=itemgetter(0)):
        _, runs, seconds, counts = zip(*part)
        found, place = np.unique(np.concatenate(seconds), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)
        cuts = np.cumsum([len(s) for s in seconds])[:-1]
        yield first, found, total, list(runs), np.split(place, cuts)


def radix_of(first: np.ndarray, radices: int) -> np.ndarray:
    return (T.mix(first.astype(np.uint64)) % np.uint64(radices)).astype(np.int64)


DIGEST = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, key: str, text: str, radices: int, folder: str, files: tuple[str, str]) -> DataFrame:
    """One row per block: its documents' own numbers, its pair-document records, and its runs by radix."""
    kind = docs.schema[key].dataType.simpleString()
    first_path, second_path = (os.path.join(folder, f) for f in files)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_level(first_path), piece_level(second_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column("_text")
            for begin, _, borders in T.runs(column, BLOCK_BYTES):
                n = len(borders) - 1
                aligned = align_texts(column.slice(begin, n).to_pylist(), first, second)
                link_doc = aligned.a_doc[aligned.link_a]
                own = [np.bincount(d, minlength=n) for d in (aligned.a_doc, aligned.b_doc, aligned.group_doc, link_doc)]
                listed = group_texts(aligned, n)
                hashes = [hashlib.sha256(g.encode("ascii")).hexdigest() if g else "" for g in listed]
                a, b = aligned.a[aligned.link_a], aligned.b[aligned.link_b]
                pair = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
                distinct, place = np.unique(pair, return_inverse=True)
                radix = radix_of((distinct >> np.uint64(32)), radices)
                order = np.argsort(radix, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                record, times = np.unique(rank[place] * n + link_doc, return_counts=True)
                holders = np.bincount(record // n, minlength=len(distinct)).astype(np.uint32)
                records = packed(holders), packed((record % n).astype(np.uint32), times.astype(np.uint32))
                distinct, radix = distinct[order], radix[order]
                cuts = np.searchsorted(radix, np.arange(radices + 1))
                runs = [
                    {"radix": r, "run": write_run(distinct[i:j], holders[i:j])}
                    for r, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0).slice(begin, n)),
                        *[pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(c, pa.int64())) for c in own],
                        pa.array([hashes], pa.list_(pa.string())),
                        pa.array([records[0]], pa.binary()), pa.array([records[1]], pa.binary()),
                        pa.array([runs], pa.list_(pa.struct([("radix", pa.int32()), ("run", pa.binary())]))),
                    ],
                    ["block", "keys", *DIGEST, "hashes", "holders", "records", "runs"],
                )
                number += 1

    numbers = ", ".join(f"{c} array<long>" for c in DIGEST)
    return docs.select(key, F.col(text).alias("_text")).mapInArrow(
        encode,
        f"block long, keys array<{kind}>, {numbers}, hashes array<string>, holders binary, records binary, "
        "runs array<struct<radix: int, run: binary>>",
    )


def _by_radix(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[int], BinaryIO, list[tuple[int, int]]]]:
    """(radix, blocks, file, spans of the runs) of sorted rows; the file lies in memory up to SPILL_BYTES."""
    rows = ((r, b, run) for batch in batches for r, b, run in zip(*[batch.column(c).to_pylist() for c in ("radix", "block", "run")]))
    for radix, part in groupby(rows, key=itemgetter(0)):
        with tempfile.SpooledTemporaryFile(max_size=SPILL_BYTES) as file:
            numbers, spans, at = [], [], 0
            for _, block, run in part:
                file.write(run)
                numbers.append(block)
                spans.append((at, at + len(run)))
                at += len(run)
            yield radix, numbers, file, spans


def contributions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, radix, part, found): counts of a block's pairs in the order of its run, and whether each is its side's highest."""

    def rows(radix, part, waiting):
        found = [packed(np.concatenate([t for t, _ in w]).astype(np.uint64), np.concatenate([h for _, h in w]).astype(np.uint8)) for w in waiting.values()]
        size = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(waiting), pa.int64()), pa.array([radix] * size, pa.int32()), pa.array([part] * size, pa.int32()), pa.array(found, pa.binary())],
            ["block", "radix", "part", "found"],
        )

    for radix, numbers, file, spans in _by_radix(batches):
        waiting: dict[int, list] = {}
        size = part = 0
        for _, _, total, runs, places in merged(file, spans):
            highest = total == total.max()
            for run, place in zip(runs, places):
                waiting.setdefault(numbers[run], []).append((total[place], highest[place]))
                size += 9 * len(place) + 200
            if size > SPILL_BYTES:
                yield rows(radix, part, waiting)
                waiting, size, part = {}, 0, part + 1
        if waiting:
            yield rows(radix, part, waiting)


def _table(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, file, spans in _by_radix(batches):
        for first, second, total, _, _ in merged(file, spans):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(second), first)), pa.array(second), pa.array(total), pa.array(total == total.max())], ["a", "b", "documents", "highest"]
            )


def _runs(found: DataFrame) -> DataFrame:
    return found.select("block", F.inline("runs")).select("radix", "block", "run").repartition("radix").sortWithinPartitions("radix", "block")


def _radices(docs: DataFrame) -> int:
    return min(MOST_RADICES, max(LEAST_RADICES, docs.rdd.getNumPartitions()))


def pair_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, files: tuple[str, str] = (BYTE_LEVEL, PIECES)) -> DataFrame:
    """a, b, documents and highest of every linked id pair: how many documents hold it, and whether no pair of a has more."""
    found = blocks(docs, key, text, _radices(docs), folder, files)
    return _runs(found).mapInArrow(_table, "a long, b long, documents long, highest boolean")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, files: tuple[str, str] = (BYTE_LEVEL, PIECES)) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A null or empty text, or one that a tokenizer changes, has no tokens: zeros and an empty groups_sha256. Rows are documents
    of their own, also where keys repeat or are null. An empty table gives no rows; only the key and the text are read.
    `folder` holds the tokenizers' files, at the same place on every machine.
    """
    found = stage(blocks(docs, key, text, _radices(docs), folder, files))
    back = _runs(found).mapInArrow(contributions, "block long, radix int, part int, found binary")
    kind = docs.schema[key].dataType.simpleString()

    def total(block: pa.Table, parts: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in ("keys", *DIGEST, "hashes")}
        n = len(row["keys"].values)
        counts, highest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in parts.sort_by([("radix", "ascending"), ("part", "ascending")]).column("found").to_pylist():
            c, h = unpacked(part, np.uint64, np.uint8)
            counts.append(c.astype(np.int64))
            highest.append(h.astype(np.int64))
        (holders,) = unpacked(block.column("holders")[0].as_py(), np.uint32)
        doc, times = (x.astype(np.int64) for x in unpacked(block.column("records")[0].as_py(), np.uint32, np.uint32))
        best, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(best, doc, times * np.repeat(np.concatenate(highest), holders))
        np.add.at(sums, doc, times * np.repeat(np.concatenate(counts), holders))
        columns = {"key": row["keys"].values} | {c: row[c].values for c in DIGEST}
        return pa.table(columns | {"n_best": best, "count_sum": sums, "groups_sha256": row["hashes"].values})

    numbers = ", ".join(f"{c} long" for c in (*DIGEST, "n_best", "count_sum"))
    joined = found.drop("runs").groupBy("block").cogroup(back.groupBy("block"))
    return joined.applyInArrow(total, f"key {kind}, {numbers}, groups_sha256 string").withColumnRenamed("key", key)
