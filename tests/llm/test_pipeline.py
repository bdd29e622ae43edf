"""The pipeline's stages, each on what the stage before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from netstate.llm import decontam, quality, queries
from tests.llm.samples import odd
from tests.llm.test_corpus import kept_lines
from tests.llm.test_superminhash import expected as all_pairs

SF = "/root/testdata/sf0.01"


def test_run_equals_its_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    model = quality.train_quality(queries.rated(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    good = {r.doc_id for r in quality.grade_quality(docs, model).where("tails[0] >= 0.5").collect()}
    rest = pipeline.quality_classifier(spark, docs, SF)
    assert {r.doc_id for r in rest.select("doc_id").collect()} == good and rest.columns == names
    texts = {r.doc_id: r.text for r in rest.collect()}
    keys = sorted(texts)
    cut = pipeline.line_dedup(spark, rest, SF)
    expected = kept_lines([texts[k] for k in keys], 50)
    rows = {r.doc_id: r for r in cut.collect()}
    assert {k: r.text for k, r in rows.items()} == {keys[i]: t for i, t in expected.items()} and cut.columns == names
    assert all(r.n_chars == len(r.text) for r in rows.values())
    single = pipeline.near_dedup(spark, cut, SF)
    groups = {root for _, _, root, _ in all_pairs(cut.collect(), 80)}
    assert {r.doc_id for r in single.collect()} == groups and single.columns == names
    clean = pipeline.decontamination(spark, single, SF)
    leaked = {r.doc_id for r in decontam.find_leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked and clean.columns == names
    mixed = pipeline.mix(spark, clean, SF)
    whole = pipeline.run(spark, SF)
    key = lambda frame: sorted((r.doc_id, r.shard, r.shuffle_key) for r in frame.collect())
    assert key(mixed) == key(whole)


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows_and_empty_tables(spark, number):
    stage = pipeline.STAGES[number][1]
    docs = odd(spark)
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert set(docs.columns) <= set(out.columns) and 0 < out.count()
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = odd(spark)
    kept = [r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()]
    assert len(kept) == len(set(kept))
    assert 10 in kept and 11 not in kept and 0 in kept and 1 not in kept
    unknown = docs.where("doc_id in (4, 7, 9)").withColumn("doc_id", F.lit(None).cast("long"))
    assert pipeline.near_dedup(spark, unknown.union(unknown), SF).count() == 3


def test_near_dedup_keeps_columns_of_any_name(spark):
    docs = odd(spark).withColumn("_th", F.lit("mine")).withColumn("n", F.lit(3)).withColumn("root", F.lit("r")).withColumn("id", F.lit(5))
    out = pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns and {(r["_th"], r["n"], r["root"], r["id"]) for r in out.collect()} == {("mine", 3, "r", 5)}
