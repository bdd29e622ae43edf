"""Counts of rules, licenses and fingerprints against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from netstate.llm import licenses, queries, rules, simhash
from netstate.llm import text as T
from tests.llm.samples import ODD, odd, rows

SPACE = "[^\x20\x09-\x0D]+"
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def signals(t):
    t = t or ""
    w = re.findall(SPACE, t)
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def run_of(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab #|\n\té\x0b", max_size=40), min_size=1, max_size=6))
def test_counts_equal_plain_python(texts):
    got = rules.count_run(*run_of(texts))
    assert [tuple(int(got[c][i]) for c in rules.COUNTS) for i in range(len(texts))] == [signals(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abAB é", max_size=12), min_size=1, max_size=5))
def test_span_hashes_name_words(texts):
    data, borders = run_of(texts)
    starts, ends, owner = T.spans(data, borders, T.NOT_SPACE)
    words = [w for t in texts for w in t.encode().split()]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == words
    assert owner.tolist() == [i for i, t in enumerate(texts) for _ in t.encode().split()]
    names = T.span_hashes(data, starts, ends).tolist()
    assert len(set(zip(words, names))) == len(set(words)) == len(set(names))


def test_rules_on_odd_rows(spark):
    counted = rules.count_signals(odd(spark))
    got = rules.apply_cutoffs(counted, rules.adaptive_cutoffs(counted)).collect()
    assert len(got) == len(ODD) + 4
    for r in got:
        if r.doc_id is not None:
            assert tuple(r[c] for c in rules.COUNTS) == signals(ODD[r.doc_id])
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    none = rules.count_signals(odd(spark).limit(0))
    assert rules.apply_cutoffs(none, rules.adaptive_cutoffs(none)).count() == 0


def test_repeated_lines_count_by_their_share(spark):
    line = lambda name, i: " ".join(f"{name}{i}w{j}" for j in range(6))
    clean = ["\n".join(line(f"c{k}x", i) for i in range(20)) for k in range(300)]
    long = "\n".join("Summary" if i % 400 == 0 else line("long", i) for i in range(2400))
    copied = "\n".join(["again"] * 9 + [line("copied", i) for i in range(9)])
    docs = rows(spark, [*clean, long, copied])
    counted = rules.count_signals(docs)
    lines = {r.doc_id: (r.n_lines, r.n_dup_lines) for r in counted.collect()}
    assert lines[0] == (20, 0) and lines[300] == (2400, 5) and lines[301] == (18, 8)
    judged = {r.doc_id: r.kept for r in rules.apply_cutoffs(counted, rules.adaptive_cutoffs(counted)).collect()}
    assert all(judged[i] for i in range(301)) and not judged[301]


def test_rules_adapt_to_their_group(spark):
    clean = [" ".join(f"word{i}{j}" for j in range(60)) for i in range(300)]
    noisy = [" ".join(f"w{i}{j} |" for j in range(40)) for i in range(300)]
    docs = rows(spark, [*clean, noisy[0], *noisy[1:], clean[0]], ["plain"] * 301 + ["tables"] * 300)
    counted = rules.count_signals(docs)
    kept = {r.doc_id for r in rules.apply_cutoffs(counted, rules.adaptive_cutoffs(counted)).where("kept").collect()}
    assert 300 not in kept  # symbols are unusual in its source
    assert set(range(300)) <= kept and set(range(301, 600)) <= kept


def license_places(t):
    words = [w.decode() for w in licenses.WORDS.findall(lower(t or "").encode())]
    found = sorted((i, b.label) for b in licenses.BASE for i in range(len(words)) if tuple(words[i : i + len(b.words)]) == b.words)
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


TEXTS = [
    "MIT License. mit LICENSE; the Apache-License", "general public\nlicense general public license", "mit", "license mit",
    "Licensed under CC BY-NC 4.0.", "x\nThis work is licensed under the GNU General Public License, version 3.", "mit licence", "apache",
    "Licenced under the Apache License, Version 2.0", "under the terms of Apache License version 3", "generalpublic license mit2 license",
]


def test_license_base_equals_plain_python(spark):
    texts = [*TEXTS, *ODD, *[" ".join(TEXTS)] * 3]
    docs = rows(spark, texts)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, licenses.document_frequencies(docs)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_places(t)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
    assert got[4].labels == "cc-by-nc-4.0" and got[5].labels == "gpl,gpl-3.0" and got[8].labels == "apache,apache-2.0"
    assert licenses.scan_licenses(docs.limit(0), licenses.document_frequencies(docs.limit(0))).count() == 0
    assert licenses.scan_licenses(odd(spark), licenses.document_frequencies(odd(spark))).count() == len(ODD) + 4


def edits(words, text):
    """Edit distance of two lists, by its definition."""
    table = {(i, j): i + j for i in range(len(words) + 1) for j in range(len(text) + 1) if not i * j}
    for i in range(1, len(words) + 1):
        for j in range(1, len(text) + 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (words[i - 1] != text[j - 1]))
    return table[len(words), len(text)]


def notice_edits(t, words):
    """Least edits of a template over all stretches of words around its key phrases."""
    n, most = len(t.words), len(t.words) - math.ceil(licenses.AGREEMENT * len(t.words))
    keys = t.keys
    at = lambda k, i: tuple(words[i : i + k[1] - k[0]]) == t.words[k[0] : k[1]]
    near = lambda want, texts: min((edits(want, x) for x in texts), default=n)
    best = n
    for i in range(len(words)):
        if not at(keys[0], i):
            continue
        head = near(t.words[: keys[0][0]], [words[a:i] for a in range(max(0, i - n - most), i + 1)])
        stop = i + keys[0][1] - keys[0][0]
        for j in [stop] if len(keys) == 1 else range(stop, len(words)):
            middle = 0 if len(keys) == 1 else edits(t.words[keys[0][1] : keys[1][0]], words[stop:j]) if at(keys[1], j) else n
            last = j + (0 if len(keys) == 1 else keys[1][1] - keys[1][0])
            tail = near(t.words[keys[-1][1] :], [words[last:b] for b in range(last, min(len(words), last + 2 * n) + 1)])
            best = min(best, head + middle + tail)
    return best if best <= most else None


def license_labels(text):
    words = [w.decode() for w in licenses.WORDS.findall(lower(text or "").encode())]
    base = license_places(text)[4]
    found = [(t.label, 1 - e / len(t.words)) for t in licenses.NOTICES if (e := notice_edits(t, words)) is not None]
    labels = sorted({x for x, _ in found} | set(filter(None, base.split(","))))
    return ",".join(labels), max([x for _, x in found] + [1.0] * bool(base), default=0.0)


def edited(rng, words):
    """A notice with up to four words put in, left out, replaced or swapped."""
    words = list(words)
    for _ in range(rng.randint(0, 4)):
        i, kind = rng.randrange(len(words)), rng.randrange(4)
        if kind == 0:
            words.insert(i, rng.choice(["natural", "the", "license", "x9"]))
        elif kind == 1 and len(words) > 1:
            del words[i]
        elif kind == 2:
            words[i] = rng.choice(["other", "license", "version"])
        elif i:
            words[i - 1], words[i] = words[i], words[i - 1]
    return words


def test_license_notices_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [*TEXTS, None, ""]
    for t in licenses.NOTICES:
        plain = list(t.words)
        texts += [" ".join(plain), " ".join(plain[1:]), " ".join(plain[:-1]), " ".join(["pad"] * 3 + plain * 2)]
        texts += [" ".join(["lead"] * rng.randint(0, 3) + edited(rng, plain) + ["end"] * rng.randint(0, 3)) for _ in range(12)]
        texts += [" ".join(edited(rng, plain) + edited(rng, rng.choice(licenses.NOTICES).words)) for _ in range(4)]
    docs = rows(spark, texts)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, licenses.document_frequencies(docs)).collect()}
    for i, t in enumerate(texts):
        labels, score = license_labels(t)
        assert got[i].labels == labels and got[i].score == pytest.approx(score), t
        assert {s.label for s in got[i].spans} == set(filter(None, labels.split(",")))
    plain = licenses.scan_licenses(docs, licenses.document_frequencies(docs), spans=False)
    assert "spans" not in plain.columns and plain.count() == len(texts)


def test_license_notice_with_an_inserted_word(spark):
    grant = "Permission is hereby granted, free of charge, to any natural person obtaining a copy of this software and associated documentation files"
    docs = rows(spark, [f"a b\n{grant} c", grant.replace("free of charge", "free of any charge")])
    first, second = sorted(licenses.scan_licenses(docs, licenses.document_frequencies(docs)).collect())
    assert first.labels == "mit" and first.score == pytest.approx(1 - 1 / 20)
    assert [(s.label, s.start, s.end) for s in first.spans] == [("mit", 2, 23)]
    assert second.labels == "" and second.score == 0  # a key phrase must stand in full


def test_license_query_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op3_license_scan(spark, "/root/testdata/sf0.001").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_places(docs[r.doc_id])


def print_of(t):
    words = re.findall(SPACE, lower(t or ""))
    if not words:
        return 0
    own = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Least number in each component of prints within three bits."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprints_and_components_equal_plain_python(spark):
    near = " ".join(f"t{i}" for i in range(300))
    texts = [*ODD, near, near + " more", near.upper(), near.replace("t7 ", "t8 "), "b c", ""]
    prints = [print_of(t) for t in texts]
    got = sorted(simhash.near_duplicates(rows(spark, texts)).select("doc_id", simhash.hexadecimal("fingerprint").alias("f"), "component_id").collect())
    assert [r.f for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == components(prints)
    assert simhash.near_duplicates(odd(spark)).count() == len(ODD) + 4
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("file_rows", [8, 8192])
def test_links_with_large_files(spark, monkeypatch, file_rows):
    """Files above the limit are compared part by part and lose no link."""
    monkeypatch.setattr(simhash, "FILE_ROWS", file_rows)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 5, dtype=np.uint64)
    prints = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))] + rng.integers(0, 1 << 62, 40).tolist()
    prints = sorted({int(p) for p in prints})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()
    label = list(range(len(prints)))
    for _ in range(len(prints)):
        for a, b in links:
            i, j = signed.index(a), signed.index(b)
            label[i] = label[j] = min(label[i], label[j])
    assert label == components(prints)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 63, 150, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64))]))
    for radius in range(4):
        got = simhash.within(simhash.planes_of(prints), len(prints), prints[:70], radius)
        assert (got == (np.bitwise_count(prints[:70, None] ^ prints) <= radius)).all()
