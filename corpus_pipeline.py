"""Training-data pipeline: quality classifier, line dedup, SimHash near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next stage's docs. All
but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.llm import decontam, linedup, mixing, quality, simhash
from netstate.llm.queries import rated, table
from netstate.scale import ensure_checkpoint_dir, stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are of grade 1 or more with a probability of a half or more."""
    corpus = table(spark, sf_dir, "documents")
    model = quality.train_quality(rated(corpus, table(spark, sf_dir, "labels")), docs=corpus)
    return quality.select_quality(docs, model, least=1)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs."""
    cut = linedup.dedup_lines(docs).drop("n_deleted")
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id (null last), then the least hash of its text.

    Groups are connected by texts of which 80 % of the five-word shingles agree. Of rows equal in both, one stays.
    """
    mark = "_th"
    while mark in docs.columns:
        mark += "_"
    own = docs.withColumn(mark, F.xxhash64("text"))
    found = stage(simhash.similar_documents(own, keep=(mark,)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(mark).alias("hash"))
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("first.id", "first.hash").alias("f")
    kept = own.alias("o").join(first, F.col("o.doc_id").eqNullSafe(F.col("f.id")) & (F.col(f"o.{mark}") == F.col("f.hash")), "left_semi")
    repeated = not found.groupBy("doc_id", mark).count().where("count > 1").isEmpty()
    return (kept.dropDuplicates(["doc_id", mark]) if repeated else kept).drop(mark)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents, once per copy, with their shard and the key that orders it."""
    return mixing.draw_mix(docs, mixing.mix_sources(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
]

#: Models and fingerprints have no form in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder, which goes when the next one is there."""
    from uuid import uuid4

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage_of) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage_of(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs


QUERIES = {"pipeline": run}
