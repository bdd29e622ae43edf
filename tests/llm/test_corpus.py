"""Line dedup, decontamination, mixing and language-model scores against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netstate.llm import decontam, linedup, lmscore, mixing, queries
from tests.llm.samples import ODD, odd, prose, rows

SMALL = "/root/testdata/sf0.001"


def kept_lines(texts, least):
    """Texts after deleting later copies of every repeated run of at least `least` words (each pair of equal runs is looked at)."""
    docs = [[(n, x.strip(" \t\r\x0b\x0c")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] for t in texts]
    first, gone = {}, [set() for _ in docs]
    for d, lines in enumerate(docs):
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                run = tuple(x for _, x in lines[i : j + 1])
                if sum(len(x.split()) for x in run) < least:
                    continue
                e, k = first.setdefault(run, (d, i))
                if (e, k) != (d, i):
                    begin = max(i, k + len(run)) if e == d else i
                    gone[d] |= {lines[p][0] for p in range(begin, j + 1)}
                if sum(len(x.split()) for x in run[1:-1]) >= least:  # longer runs add nothing to those within them
                    break
    out = {}
    for d, t in enumerate(texts):
        if not gone[d]:
            out[d] = t
        else:
            new = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])
            if re.search("[^\x20\x09-\x0D]", new):
                out[d] = new
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(prose(i, rng.choice([1, 2, 3, 6, 9]))) for i in range(25)]
    texts = []
    for _ in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.7 else " ".join(prose(rng.random(), 4)) for _ in range(rng.randint(1, 12))]
        if texts and rng.random() < 0.5:
            other = rng.choice(texts).split("\n")
            at = rng.randrange(len(other))
            lines[rng.randrange(len(lines)) :] = other[at : at + 6] + ["", "tail"]
        texts.append("\n".join(lines))
    texts += ["x y\n" * 30, pool[0] + "\n" + "x y\n" * 30, *[t for t in ODD if t is None or len(t) < 10_000]]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(rows(spark, texts), least_words=10).collect()}
    assert got == kept_lines(texts, 10)


def test_line_dedup_keeps_columns_and_odd_rows(spark):
    docs = odd(spark)
    out = linedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_deleted"]
    # Of the long text, the row without a key is a later copy.
    assert out.count() == docs.count() - 1
    assert linedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in queries.op6_line_dedup(spark, SMALL).collect()}
    assert got == kept_lines([texts[i] for i in sorted(texts)], linedup.LEAST_WORDS)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def leaks(texts, items):
    """{(doc, item): least distance of a window of the item's size}, within the allowed edits."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    out = {}
    for d, t in enumerate(texts):
        w = words(t)
        for k, x in enumerate(items):
            v = words(x)
            if len(v) >= decontam.LEAST_WORDS:
                near = [m for i in range(len(w) - len(v) + 1) if len(set(w[i : i + len(v)]) & set(v)) > len(set(v)) / 3 and (m := edit(w[i : i + len(v)], v)) <= decontam.allowed(len(v), decontam.EDITS)]
                if near:
                    out[d, k] = min(near)
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [" ".join(prose(1000 + i, rng.randint(5, 40), 3000)) for i in range(25)] + [None, "", "too short"]
    items.append(items[0])
    texts = [t for t in ODD]
    for i in range(60):
        words = prose(i, rng.randint(0, 80), 3000)
        leak = rng.choice(items[:25]).split()
        for _ in range(rng.choice([0, 0, 1, 2, len(leak) // 5])):
            at = rng.randrange(len(leak))
            rng.choice([lambda: leak.insert(at, "new"), lambda: leak.__delitem__(at), lambda: leak.__setitem__(at, "OTHER")])()
        if i % 3:
            at = rng.randint(0, len(words))
            words[at:at] = leak if i % 2 else [w.upper() + ",!" for w in leak]
        texts.append(" ".join(words))
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(items)], "item_id long, text string, score double")
    expected = leaks(texts, items)
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find_leaks(rows(spark, texts), bench).collect()}
    assert set(got) <= set(expected)
    assert all(d >= expected[k] for k, d in got.items())
    assert {k for k, d in expected.items() if d == 0} <= set(got)
    assert len(got) >= 0.9 * len(expected) and len(expected) > 30
    clean = {r.doc_id for r in decontam.decontaminate(rows(spark, texts), bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in got}
    assert decontam.find_leaks(rows(spark, texts), bench.limit(0)).count() == 0
    assert decontam.find_leaks(rows(spark, texts).limit(0), bench).count() == 0
    assert decontam.decontaminate(odd(spark), bench).count() == len(ODD) + 4


def test_embedding_turns_few_edits_into_few_differences():
    assert decontam.repetitions_for([20, 40, 60], 0.0, 2, 0.97) == 1 and decontam.repetitions_for([], 0.2, 2, 0.97) == 1
    assert 3 < decontam.repetitions_for([20, 40, 60], 0.2, 2, 0.97) < 100
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (2, 200, 12)).astype(np.uint64)
    assert decontam.edit_distances(a, b).tolist() == [edit(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def test_decontamination_keeps_windows_beside_better_ones(spark):
    word = lambda k, name: [f"{name}{k}x{i}" for i in range(100)]
    items, texts = [], []
    for k in range(10):  # (a) before an item with a rewritten end stand pairs of another item of its size
        a, b = word(k, "a"), word(k, "b")
        items += [a, b]
        texts.append(b[40:58] + a[:82] + [f"n{k}x{i}" for i in range(18)])
    for k in range(10):  # (b) two items overlap, and the text holds the first as it is and the end of the second rewritten
        c = word(k, "c")
        items += [c, c[15:] + [f"d{k}x{i}" for i in range(15)]]
        texts.append(c + [f"m{k}x{i}" for i in range(15)])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(rows(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert sum((k, 2 * k) in got for k in range(10)) >= 9
    assert sum((k, 2 * k + 1) in got for k in range(10, 20)) >= 9 and all((k, 2 * k) in got for k in range(10, 20))


def test_decontamination_finds_whole_texts_that_lack_words(spark):
    rng = random.Random(4)
    items = [[f"i{k}x{i}" for i in range(n)] for k, n in enumerate([5, 6, 10, 15, 25, 40, 59, 80] * 5)]
    texts = []
    for k, item in enumerate(items):
        gone = rng.sample(range(len(item)), 1 if k % 2 else len(item) // 5)
        texts.append([w for i, w in enumerate(item) if i not in gone])
    texts.append(items[5][9:])  # a word more than allowed is missing
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find_leaks(rows(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert set(got) <= {(k, k) for k in range(len(items))} and len(got) >= 0.95 * len(items)
    assert all(d == len(items[k]) - len(texts[k]) for (k, _), d in got.items())


def test_repetitions_hold_for_each_size_and_kind_of_edit():
    short = decontam.repetitions_for([5, 60], 0.2, 2, 0.97, kinds=("shortened",))
    assert short > decontam.repetitions_for([5, 60], 0.2, 2, 0.97) >= decontam.repetitions_for([5], 0.2, 2, 0.97)
    with pytest.raises(ValueError, match="repetitions find"):
        decontam.repetitions_for([400], 0.4, 2, 0.97)


def test_decontamination_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, SMALL).collect()}
    plain = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    held = {(d, k) for d, t in texts.items() for k, x in items.items() if f" {plain(x)} " in f" {plain(t)} "}
    assert held <= got and len(held) > 0


def test_targets_share_the_excess():
    assert mixing.targets([10, 10, 10], [1, 1, 1]).tolist() == [10, 10, 10]
    assert mixing.targets([1, 100, 100], [3, 1, 1]).tolist() == [3, 99, 99]
    assert mixing.targets([0, 0], [1, 2]).tolist() == [0, 0]
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes, weights = rng.integers(0, 1000, 6), rng.integers(1, 4, 6)
        t = mixing.targets(sizes, weights)
        assert math.isclose(t.sum(), sizes.sum(), abs_tol=1e-6) and (t <= 3 * sizes + 1e-9).all()
        open_ = t < 3 * sizes - 1e-6
        assert np.allclose(np.diff((t / weights)[open_]), 0)  # sources below their limit share by weight


def test_splitting_tree_is_exact():
    quotas = np.array([5, 0, 1000, 37])
    dealt = mixing.split_tree(quotas, 7, np.random.default_rng(2))
    assert (dealt.sum(1) == quotas).all() and dealt.shape == (4, 7) and dealt.min() >= 0
    assert dealt.sum(0).max() - dealt.sum(0).min() <= 1


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    again = {r.doc_id: r for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert first == again and len(first) == docs.count()
    by = {}
    for r in first.values():
        assert r.taken == r["size"] * len(r.shards) <= 3 * r["size"]
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r["size"]
        s[1] += r.taken
    names = sorted(by, key=lambda s: s.encode())
    wanted = mixing.targets([by[s][0] for s in names], [1 + i % 3 for i in range(len(names))])
    for s, t in zip(names, wanted):
        assert by[s][3] == by[s][0] and math.isclose(by[s][2], t)
        assert abs(by[s][1] - t) <= 0.02 * t + 20
    drawn = mixing.draw_mix(docs, mixing.mix_sources(docs))
    counts = Counter(r.doc_id for r in drawn.select("doc_id").collect())
    assert counts == Counter({i: len(r.shards) for i, r in first.items() if r.shards})
    shard_words = drawn.groupBy("shard").agg({"n_chars": "sum"}).toPandas()
    assert len(shard_words) == mixing.SHARDS


def test_every_copy_lies_in_a_block_that_the_tree_deals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    decided = mixing.mix_sources(docs).toPandas()
    decided["src"] = decided["source"].map(lambda s: "" if s is None else "=" + s)
    words = decided["size"] * decided["rows"]
    sizes = spark.createDataFrame(words.groupby(decided["src"]).sum().rename("source_size").reset_index(), "src string, source_size long")
    plan = mixing.plan_sources(sizes, mixing.WEIGHTS, mixing.MOST_TIMES, mixing.SHARDS, 13).toPandas().set_index("src")
    for src, own in decided.groupby("src"):
        p = plan.loc[src]
        quota = p.passes * p.blocks + -(-p.part // p.block_words)
        assert p.bounds[-1] == quota
        held = {}
        for size, blocks, shards in zip(own["size"] * own["rows"], own["blocks"], own["shards"]):
            assert len(blocks) == len(shards)
            for b, shard in zip(blocks, shards):
                assert 0 <= b < quota and shard == np.searchsorted(p.bounds, b, "right")
                held.setdefault(b, []).append(size)
        for sizes_of in held.values():  # blocks are disjoint ranges of the order: only a border text may stick out on each side
            assert sum(sizes_of) <= p.block_words + 2 * max(sizes_of)


def test_mix_of_many_sources(spark):
    """A source per text: the targets are those of the plain rule, and each shard gets its share of blocks."""
    texts = [" ".join(prose(i, 5 + i % 40)) for i in range(3000)]
    docs = rows(spark, texts, [f"host{i % 2500:05d}" for i in range(3000)])
    got = mixing.mix_sources(docs).toPandas()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"))
    assert np.allclose(by["target"], mixing.targets(by["size"], [1 + i % 3 for i in range(len(by))]))
    assert (got["taken"] <= 3 * got["size"]).all() and set(got["shards"].explode().dropna()) == set(range(mixing.SHARDS))


def test_mix_keeps_columns_of_any_name(spark):
    docs = rows(spark, [" ".join(prose(i, 30)) for i in range(20)] + ["", None], ["a", "b"] * 11)
    docs = docs.withColumn("_unit", F.lit("mine")).withColumn("_copy", F.lit(4)).withColumn("shards", F.lit("s")).withColumn("_k", F.lit(1))
    out = mixing.draw_mix(docs, mixing.mix_sources(docs))
    assert out.columns == [*docs.columns, "shard", "shuffle_key"]
    assert {(r["_unit"], r["_copy"], r["shards"], r["_k"]) for r in out.collect()} == {("mine", 4, "s", 1)}
    silent = docs.where("doc_id >= 20")
    assert mixing.draw_mix(silent, mixing.mix_sources(silent)).count() == 0


def test_mix_of_odd_rows(spark):
    docs = odd(spark)
    decided = mixing.mix_sources(docs)
    assert sum(r.rows for r in decided.collect()) == docs.count()
    assert all(r.taken <= 3 * r["size"] for r in decided.collect())
    assert mixing.draw_mix(docs, decided).columns == [*docs.columns, "shard", "shuffle_key"]
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def scores(texts, backoff=0.4):
    tokens = [re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    one, two = Counter(w for t in tokens for w in t), Counter(p for t in tokens for p in zip(t, t[1:]))
    total, out = sum(one.values()), []
    for t in tokens:
        own, pairs, rest, z = Counter(t), Counter(zip(t, t[1:])), max(1, total - len(t)), 0.0
        for i, w in enumerate(t):
            c = one[w] - own[w]
            plain = math.log(c / rest) if c else math.log(backoff / rest)
            if not i:
                z += plain
            elif (n := two[t[i - 1], w] - pairs[t[i - 1], w]) > 0:
                z += math.log(n / (one[t[i - 1]] - own[t[i - 1]]))
            else:
                z += math.log(backoff) + plain
        out.append((len(t), z))
    return out


@pytest.mark.parametrize("bounds", [{}, {"word_rows": 6, "pair_rows": 3}, {"word_rows": 0, "pair_rows": 0}])
def test_language_model_scores_equal_brute_force(spark, bounds):
    texts = [" ".join(prose(i, 120, 60)) for i in range(25)] + [t for t in ODD if t is None or len(t) < 10_000]
    got = {r.doc_id: r for r in lmscore.score_texts(rows(spark, texts).repartition(3), **bounds).collect()}
    assert len(got) == len(texts)
    for i, (n, z) in enumerate(scores(texts)):
        assert got[i].n_words == n and math.isclose(got[i].log_score, z, rel_tol=1e-6, abs_tol=1e-5)
        assert (got[i].mean_log_score is None) == (n == 0)


def test_language_model_query_equals_brute_force(spark):
    table = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r.log_score for r in queries.op10_lm_score(spark, SMALL).collect()}
    for r, (_, z) in zip(table, scores([r.text for r in table])):
        assert math.isclose(got[r.doc_id], z, rel_tol=1e-6)


def test_language_model_on_odd_rows(spark):
    assert lmscore.score_texts(odd(spark)).count() == len(ODD) + 1  # rows without a key count as one text
    assert lmscore.score_texts(odd(spark).limit(0)).count() == 0


def test_a_text_of_many_equal_lines_takes_time_in_proportion(spark):
    """Fifty thousand equal lines, of which the first run stays."""
    docs = rows(spark, ["tick tock\n" * 50_000 + "end", "other words here"]).withColumn("_th", F.lit("mine"))
    out = {r.doc_id: r for r in linedup.dedup_lines(docs).collect()}
    assert out[0].text.count("tick") < 100 and out[0].text.endswith("end") and out[0]["_th"] == "mine" and out[1].n_deleted == 0
    assert out[0].n_deleted + out[0].text.count("\n") == 50_000


def test_texts_without_key_do_not_displace_each_other(spark):
    """Two rows without key hold windows at the same word; only one is the item."""
    item = " ".join(prose(8, 30))
    words = item.split(" ")
    close = " ".join(words[:22] + [f"z{k}" for k in range(8)])
    lead = " ".join(prose(9, 12))
    docs = rows(spark, [f"{lead} {close} more words", f"{lead} {item} more words"]).withColumn("doc_id", F.lit(None).cast("long"))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.item_id for r in decontam.find_leaks(docs, items).collect()] == [1]
    clashing = docs.withColumn("_leak", F.lit("mine"))
    assert decontam.decontaminate(clashing, items).count() == 0
