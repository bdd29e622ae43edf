"""SuperMinHash near-duplicates against all pairs of full sets."""

import random
from collections import defaultdict

import numpy as np
import pytest

from netstate.llm import queries, superminhash
from tests.llm.samples import odd, prose, rows

SF = "/root/testdata/sf0.01"


def shingles(text, words=5):
    if text is None:
        return frozenset()
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = [w for w in lowered.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def expected(records, percent=85):
    """Rows of near_duplicates from all pairs that share a shingle."""
    sets = [shingles(r.text) for r in records]
    parent = list(range(len(records)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(i)
    shared = defaultdict(int)
    for found in holders.values():
        for i, a in enumerate(found):
            for b in found[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, r in enumerate(records):
        if r.doc_id is not None:
            least[top(i)] = min(r.doc_id, least.get(top(i), r.doc_id))
    out = []
    for i, r in enumerate(records):
        root = least.get(top(i)) if sets[i] else r.doc_id
        out.append((r.doc_id, len(sets[i]), root, r.doc_id == root))
    return out


def same(got, records):
    text = lambda row: tuple(map(str, row))
    return sorted(map(tuple, got), key=text) == sorted(expected(records), key=text)


def edited(words, changes, seed):
    rng, words = random.Random(seed), list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def test_query_equals_all_pairs(spark):
    records = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert same(queries.QUERIES["op13_superminhash"](spark, SF).collect(), records)


def test_groups_of_copies_near_the_threshold(spark):
    """Copies of one text whose similarities lie on both sides of 0.85, chains of edits, and texts that share half."""
    texts = []
    for group in range(6):
        base = prose(group, 300)
        texts += [" ".join(base)] + [edited(base, k % 9, 100 * group + k) for k in range(30)]
    chain = prose(77, 200)
    for k in range(12):
        texts.append(" ".join(chain))
        chain[k * 15] = f"c{k}"
    half = prose(50, 150)
    texts += [" ".join(half + prose(1000 + k, 150)) for k in range(20)]
    docs = rows(spark, texts)
    assert same(superminhash.near_duplicates(docs).collect(), docs.collect())


@pytest.mark.parametrize("part", [1024, 7])
def test_components_left_are_compared_in_their_buckets(spark, monkeypatch, part):
    """Copies of a base that is not there: most pairs lie just below the threshold, some above it."""
    monkeypatch.setattr(superminhash, "PART", part)
    texts = [edited(prose(5, 200), 1 + k % 6, k) for k in range(60)]
    docs = rows(spark, texts)
    got = superminhash.near_duplicates(docs).collect()
    assert same(got, docs.collect()) and 5 < len({r.component_id for r in got}) < 60


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark)
    got = superminhash.near_duplicates(docs).collect()
    assert same(got, docs.collect())
    assert superminhash.near_duplicates(docs.limit(0)).collect() == []
    assert superminhash.near_duplicates(docs.where("text is null")).count() > 0


def test_signatures_are_permutations_and_less_varied_than_independent_hashes():
    rng = np.random.default_rng(1)
    single = superminhash.signatures(np.array([9], np.uint64), np.array([0]), 1, 120)[0]
    assert sorted((single >> 24).tolist()) == list(range(120))
    agree = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 540).astype(np.uint64)
        both = np.concatenate([pool[:400], pool[140:]])
        values = superminhash.signatures(both, np.repeat([0, 1], 400), 2, 120)
        agree.append((values[0] == values[1]).mean())
    similarity = 260 / 540
    assert abs(np.mean(agree) - similarity) < 0.02
    assert np.std(agree) < np.sqrt(similarity * (1 - similarity) / 120)


def test_a_long_text_in_pieces_has_the_signature_of_its_set():
    rng = np.random.default_rng(2)
    found = rng.integers(0, 2**63, 5000).astype(np.uint64)
    whole = superminhash.signatures(found, np.zeros(5000, int), 1, 60)
    superminhash.PIECE, before = 700, superminhash.PIECE
    try:
        assert (superminhash.signatures(found, np.zeros(5000, int), 1, 60) == whole).all()
    finally:
        superminhash.PIECE = before


def test_bands_miss_no_similar_pair():
    """Pairs of similarity 0.85 and more share a bucket."""
    rng = np.random.default_rng(3)
    pairs, missed = 300, 0
    for _ in range(pairs):
        pool = rng.integers(0, 2**63, 235).astype(np.uint64)
        both = np.concatenate([pool[:217], pool[18:]])
        values = superminhash.signatures(both, np.repeat([0, 1], 217), 2, superminhash.BANDS * superminhash.ROWS)
        buckets = superminhash.band_hashes(values, superminhash.BANDS, superminhash.ROWS)
        missed += not (buckets[0] == buckets[1]).any()
    assert missed == 0
