"""Token alignment against both tokenizers' own libraries and counts over all documents in memory."""

import hashlib
import io
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from netstate.llm import alignment, queries
from tests.helpers import SMALL
from tests.llm.samples import LONG, odd, rows

FOLDER = alignment.TOKENIZERS


@pytest.fixture(scope="module")
def own():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(f"{FOLDER}/{alignment.BYTE_LEVEL}")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{alignment.PIECES}")
    alphabet = alignment.byte_alphabet()

    def encode(text):
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        a_bytes = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == whole == b"".join(b_bytes) else ([], [], [], [])

    return encode


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def expected(records, encode):
    found = []
    for r in records:
        a, a_bytes, b, b_bytes = encode(r.text) if r.text else ([], [], [], [])
        a_spans, b_spans = spans(a_bytes), spans(b_bytes)
        borders = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        groups = [([], []) for _ in borders]
        for side, (ids, places) in enumerate(((a, a_spans), (b, b_spans))):
            at = 0
            for i, (_, end) in zip(ids, places):
                while end > borders[at]:
                    at += 1
                groups[at][side].append(i)
        links, j = [], 0
        for i, (s, e) in enumerate(a_spans):
            while j and b_spans[j][0] > s:
                j -= 1
            while j < len(b_spans) and b_spans[j][0] < e:
                if b_spans[j][1] > s:
                    links.append((a[i], b[j]))
                j += 1
            j = max(0, j - 1)
        found.append((r.doc_id, a, b, groups, links))
    holders = Counter(pair for *_, links in found for pair in set(links))
    highest = defaultdict(int)
    for (a, _), n in holders.items():
        highest[a] = max(highest[a], n)
    for key, a, b, groups, links in found:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(holders[p] == highest[p[0]] for p in links)
        yield (
            key, len(a), len(b), len(groups), len(links), best, sum(holders[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        )


def same(got, records, encode):
    text = lambda row: tuple(map(str, row))
    return sorted(map(tuple, got), key=text) == sorted(expected(records, encode), key=text)


def test_query_equals_both_libraries(spark, own):
    records = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert same(queries.QUERIES["op11_alignment"](spark, SMALL).collect(), records, own)


def test_odd_rows_and_empty_tables(spark, own):
    docs = odd(spark)
    assert same(alignment.align(docs).collect(), docs.collect(), own)
    strange = ["a <|endoftext|> b", "<s> x </s>", "low▁line", "tab\tand  two spaces ", "\n\nline\r\n", "ﬁne Å", "😀👩‍👩‍👧 ok", "퟿\u0085 x", "0" * 3000, "don't we'll"]
    docs = rows(spark, strange)
    got = alignment.align(docs).collect()
    assert same(got, docs.collect(), own) and any(r.n_a > 0 for r in got)
    assert alignment.align(docs.limit(0)).collect() == []
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in alignment.align(docs.where("doc_id < 0").union(rows(spark, [None, ""]))).collect())


def test_many_small_blocks_and_spilled_runs_give_the_same(spark, own, monkeypatch):
    """Blocks, frames and memory so small that every part of a merge is cut."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)
    found = alignment.blocks(docs, "doc_id", "text", 3, FOLDER, (alignment.BYTE_LEVEL, alignment.PIECES)).select("block", "runs").collect()
    for name, value in (("FRAME", 7), ("SPILL_BYTES", 900)):
        monkeypatch.setattr(alignment, name, value)
    import pyarrow as pa

    held = sorted((r["radix"], b.block, bytes(r["run"])) for b in found for r in b.runs)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([h[0] for h in held], pa.int32()), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.binary())], ["radix", "block", "run"]
    )
    cut = [r for part in alignment.contributions([batch]) for r in part.to_pylist()]
    assert max(r["part"] for r in cut) > 0
    monkeypatch.undo()
    whole = [r for part in alignment.contributions([batch]) for r in part.to_pylist()]

    def joined(rows_):
        out = defaultdict(list)
        for r in sorted(rows_, key=lambda r: (r["block"], r["radix"], r["part"])):
            counts, highest = alignment.unpacked(r["found"], np.uint64, np.uint8)
            out[r["block"], r["radix"]] += list(zip(counts.tolist(), highest.tolist()))
        return out

    assert joined(cut) == joined(whole)


def test_runs_survive_frames_of_any_size(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 5)
    rng = random.Random(1)
    pairs = np.array(sorted({rng.randrange(6) << 32 | rng.randrange(9) for _ in range(60)}), np.uint64)
    counts = np.arange(1, len(pairs) + 1).astype(np.uint32)
    data = alignment.write_run(pairs, counts)
    back = [(a << 32 | int(b), int(c)) for a, _, bs, cs in alignment.sides(io.BytesIO(data), 0, len(data), 0) for b, c in zip(bs, cs)]
    assert back == list(zip(pairs.tolist(), counts.tolist()))


def test_pair_table(spark, own):
    docs = rows(spark, ["to be or not to be", "to be", LONG[:2000]])
    got = {(r.a, r.b): (r.documents, r.highest) for r in alignment.pair_counts(docs).collect()}
    links = [set() for _ in range(3)]
    for r in docs.collect():
        a, a_bytes, b, b_bytes = own(r.text)
        for i, (s, e) in zip(a, spans(a_bytes)):
            links[r.doc_id] |= {(i, j) for j, (s2, e2) in zip(b, spans(b_bytes)) if s2 < e and s < e2}
    counts = Counter(p for s in links for p in s)
    assert {k: v[0] for k, v in got.items()} == dict(counts)
    assert all(h == (n == max(m for (a2, _), m in counts.items() if a2 == a)) for (a, _), (n, h) in got.items())
