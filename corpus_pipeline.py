"""A corpus from raw documents to shards: language, near-duplicates, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm.banding import split_by
from planforge.llm.decontaminate import decontaminate
from planforge.llm.language import UNKNOWN, held_out, predict_language, train_language
from planforge.llm.minhash import document_key, surplus_rows
from planforge.llm.mixing import apply_mix
from planforge.llm.sharding import shard_documents
from planforge.llm.storage import materialize, row_key


LEAST_SCORE = 0.3  # of a language that counts as told


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which no language can be told: null texts, texts
    without a letter, and those whose predicted language has a score under ``LEAST_SCORE``.

    If no document has a language to learn from, there is no score, and only
    the former are dropped.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").alias("key"), "text", "lang")
    told = predict_language(docs, train_language(rows), carry=tuple(docs.columns), without_model="")
    sure = (F.col("lang_pred") == "") | (F.col("score") >= LEAST_SCORE)
    return told.where((F.col("lang_pred") != UNKNOWN) & sure).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked at 0.8 of five-word shingles, and all rows without words.

    It is the row with the smallest (id, row key), rows without an id last; of
    rows with the same id and text the smallest in all columns.
    """
    surplus = materialize(surplus_rows(docs).withColumnRenamed("row_key", "_row"), "pipeline-duplicates")
    keyed = docs.withColumn("_row", document_key())
    kept = split_by(keyed, surplus, "_row")[1].select(*docs.columns)
    repeated = surplus.where("chosen").select("_row")
    if repeated.isEmpty():
        return kept
    once = split_by(keyed, repeated, "_row")[0].groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("least"))
    return kept.union(once.select(*(F.col(f"least.{c}") for c in docs.columns)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage.

    Found texts are named by a 64-bit hash; the few rows with such a hash are
    numbered and judged again, so that no chance collision drops a clean one.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("_row", F.xxhash64("text"))
    leaks = materialize(decontaminate(keyed, bench, id_col="_row").select("_row").distinct(), "pipeline-leaks")
    leaky, others = split_by(keyed, leaks, "_row")
    suspects = materialize(leaky.withColumn("_number", F.monotonically_increasing_id()), "pipeline-suspects")
    found = materialize(decontaminate(suspects, bench, id_col="_number").select("_number"), "pipeline-found")
    clean = suspects.join(found, "_number", "left_anti").select(*docs.columns)
    return others.select(*docs.columns).union(clean)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources share the words by weight."""
    return apply_mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each row's shard and slot; equal rows get a slot each."""
    keyed = docs.withColumn("_row", row_key(*(F.col(c) for c in docs.columns)))
    places = shard_documents(keyed, row_col="_row").select("_row", *PLACES)
    return keyed.dropDuplicates(["_row"]).join(places, "_row").select(*docs.columns, *PLACES)


PLACES = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Language models and minima of hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
