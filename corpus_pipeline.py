"""The training-data pipeline over ``documents``.

STAGES lists (name, function) in order; each function takes
(spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
to the shared checkpoint folder and reads again as the next stage's docs. All
stages but the last return the columns of ``documents``; the last returns the
packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm import decontaminate, langid, neardup, packing, secret_scan
from campusflow.llm.common import Shared, documents, prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are in none of the languages learned: null
    texts, texts without a letter, and texts that every one-versus-rest
    classifier refuses clearly. The model learns from all labelled rows."""
    prepare(spark)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    scored = langid.predict(rows, langid.train(docs), ["row"])
    return scored.where(~langid.rejected()).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles,
    similarity 0.8): the one with the smallest doc_id. Rows that repeat doc_id
    and text stay once; rows of one doc_id with different texts stay together,
    so no text is lost. Rows with a null doc_id belong to no group and stay."""
    found = neardup.near_duplicates(spark, docs, words=5, percent=80)
    kept = found.where("kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text"))
    named = named.dropDuplicates(["doc_id", "_text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a copy of a benchmark item. Rows are told
    apart by a hash of their text, so that rows with a null or repeated doc_id
    are judged by their own texts; null texts stay."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    named = docs.select(F.xxhash64("text").alias("doc_id"), "text").where("text is not null")
    bad = decontaminate.contaminated(spark, named, benchmark).select(F.col("doc_id").alias("_text")).distinct()
    return docs.withColumn("_text", F.xxhash64("text")).join(bad, "_text", "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found; n_chars follows the new text."""
    prepare(spark)
    return secret_scan.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document tokenised, cut and packed into sequences."""
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the model-based stages; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = shared.table(stage(spark, docs, sf_dir))
    return docs
