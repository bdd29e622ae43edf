"""Held-out accuracy of the trained models, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netstate.llm import langid, quality, queries, toxicity
from tests.llm.samples import ODD, odd, rows

LARGE = "/root/testdata/sf0.1"


def test_language_of_held_out_texts(spark):
    got = queries.op2_language_id(spark, LARGE).join(spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99


def test_language_of_odd_rows(spark):
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    network = langid.train_language_network(train)
    got = {r.doc_id: r for r in langid.identify_language(odd(spark), network).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {i for i, r in got.items() if r.lang_pred == "und" and i is not None} == {i for i, t in enumerate(ODD) if not any(c.isalpha() for c in t or "")}
    nothing = langid.train_language_network(train.where("lang is null"))
    assert {r.lang_pred for r in langid.identify_language(odd(spark), nothing).collect()} == {"und"}
    assert langid.identify_language(odd(spark).limit(0), network).count() == 0


@pytest.mark.parametrize("length", [0, 1, 191, 192, 193, 1000])
def test_windows_cover_every_byte(length):
    data = np.arange(length, dtype=np.int64).astype(np.uint8)
    starts, owner, ends = langid.windows_of(data, np.array([0, length]), 192, 3)
    assert {b for s in starts for b in range(s, min(s + 192, length))} == set(range(length))


def test_two_bytes_at_once_give_the_same_network():
    network = langid.ByteNetwork(["a", "b", "c"])
    network.start(3)
    x = np.random.default_rng(0).integers(0, 256, (7, 192)).astype(np.uint8)
    assert np.allclose(network.forward(x)[2], network.predictor()(x), atol=1e-5)


def test_toxicity_of_held_out_texts(spark):
    got = queries.op8_toxicity(spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic = got.toxic == 1
    order = got.score.rank()
    auc = (order[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum()
    assert auc > 0.96
    assert got.predicted[toxic].mean() > 0.75 and got.predicted[~toxic].mean() < 0.02
    assert (got.predicted == (got.score >= 0.5)).all()


def test_toxicity_of_the_longest_texts(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_toxicity(queries.labelled(docs, labels.where("doc_id % 4 <> 0"), "toxic"))
    held = queries.labelled(docs, labels.where("doc_id % 4 = 0"), "toxic").toPandas()
    long = held[held.text.str.len() >= held.text.str.len().quantile(0.9)]
    # Characters that no labelled text has, in about a million distinct n-grams, say nothing of a text.
    rng = np.random.default_rng(0)
    noise = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 200_000)))
    texts = [*long.text, *(t + "\n" + noise for t in long.text[:20])]
    # Clean texts joined to 200,000 characters.
    clean = "\n".join(held.text[held.toxic == 0])
    joined = [clean[i : i + 200_000] for i in range(0, len(clean) - 200_000, 200_000)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(rows(spark, texts + joined), model).collect()}
    score = np.array([got[i] for i in range(len(got))])
    y = long.toxic.to_numpy() == 1
    alone = score[: len(y)]
    assert np.allclose(score[len(y) : len(y) + 20], alone[:20], atol=0.01)
    assert ((alone[:, None] > alone[~y]).mean(1)[y]).mean() > 0.96
    assert (alone[y] >= 0.5).mean() > 0.75 and (alone[~y] >= 0.5).mean() < 0.05
    assert len(joined) > 3 and (score[len(texts) :] < 0.5).all()


def test_toxicity_of_odd_rows(spark):
    train = rows(spark, ["you idiot clown", "fine day", "an idiot", "a good day"] * 10).withColumn("toxic", (F.col("doc_id") + 1) % 2)
    model = toxicity.train_toxicity(train)
    got = toxicity.score_toxicity(odd(spark), model).collect()
    assert len(got) == len(ODD) + 4 and all(0 <= r.score <= 1 for r in got)
    for none in (train.limit(0), train.where("toxic = 1"), train.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.score_toxicity(odd(spark), toxicity.train_toxicity(none)).count() == len(ODD) + 4


def test_quality_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    rated = queries.rated(docs, labels)
    model = quality.train_quality(rated.where("doc_id % 4 <> 0"))
    assert model.grades == [0, 1, 2] and (np.diff(model.cuts) > 0).all()
    kept = quality.select_quality(rated.where("doc_id % 4 = 0"), model, 1)
    counts = dict(kept.groupBy("quality").count().collect())
    every = dict(rated.where("doc_id % 4 = 0").groupBy("quality").count().collect())
    assert counts[1] > 0.99 * every[1] and counts.get(0, 0) < 0.15 * every[0]


def test_quality_of_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_quality(queries.rated(docs, labels))
    graded = quality.grade_quality(odd(spark), model).collect()
    assert len(graded) == len(ODD) + 4
    for r in graded:
        assert 0 <= r.expected_grade <= 2 and r.tails == sorted(r.tails, reverse=True)
    kept = quality.select_quality(odd(spark), model, 1)
    assert kept.columns == odd(spark).columns
    assert kept.count() == sum(r.tails[0] >= 0.5 for r in graded)
    assert quality.select_quality(odd(spark), model, 5).count() == 0
    one = quality.train_quality(queries.rated(docs, labels).where("rating = 2"))
    assert quality.select_quality(odd(spark), one, 1).count() == len(ODD) + 4
    assert quality.train_quality(queries.rated(docs, labels).limit(0)).grades == [0]
