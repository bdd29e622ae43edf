"""Similar documents by bit-sliced comparison of wide fingerprints, against all pairs of full sets."""

from collections import defaultdict

import numpy as np
import pytest

from netstate.llm import simhash, superminhash
from tests.llm.samples import odd, prose, rows
from tests.llm.test_superminhash import edited, expected


def groups(spark, docs):
    found = defaultdict(list)
    for r in simhash.similar_documents(docs).collect():
        found[r.root].append(r.doc_id)
    return {key: min(own) for own in found.values() for key in own}


@pytest.mark.parametrize("radius", [0, 1, 3, 7, 30, 64])
def test_bit_slices_count_like_popcount(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (1, 2)).astype(np.uint64)
    flips = rng.random((150, 128)) < rng.choice([0.01, 0.1, 0.25, 0.5], (150, 1))
    prints = base ^ np.packbits(flips, axis=1).view(np.uint64)
    planes = np.concatenate([simhash.planes_of(prints[:, k].copy()) for k in range(2)])
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    true = (bits[:, None, :] != bits[None]).sum(2) <= radius
    assert (simhash.within_radius(planes, len(prints), prints, radius) == true).all()


@pytest.mark.parametrize("part", [1024, 40])
def test_planted_near_copies_are_found_and_others_left_alone(spark, monkeypatch, part):
    """Copies with up to eight changed words of 250, whose similarities go from 0.97 to 0.73, many of them just about 0.8."""
    monkeypatch.setattr(superminhash, "PART", part)
    texts = []
    for group in range(40):
        base = prose(group, 250)
        texts += [" ".join(base)] + [edited(base, k, 1000 * group + k) for k in range(1, 9)]
    docs = rows(spark, texts)
    true = {key: root for key, _, root, _ in expected(docs.collect(), 80)}
    got = groups(spark, docs)
    copies = [k for k in true if true[k] != k]
    assert sum(got[k] != k for k in copies) >= 0.97 * len(copies) > 100
    assert all(got[k] == k for k in true if k not in copies)


def test_files_reach_their_recall_at_any_size():
    for prints in (0, 1, 10_000, 10**9):
        places = simhash.files_for(prints)
        chance = 1 - (1 - simhash.AGREE ** len(places[0])) ** len(places)
        assert chance >= simhash.RECALL


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark)
    found = simhash.similar_documents(docs, keep=("n_chars",)).collect()
    assert len(found) == docs.count()
    by_root = defaultdict(set)
    for r in found:
        by_root[r.root].add(r.doc_id)
    assert {0, 1, 2, 3} in by_root.values() and {10, 11} in by_root.values() and {4, None} in by_root.values()
    assert simhash.similar_documents(docs.limit(0)).collect() == []
