"""The corpus pipeline: drop toxic documents, near duplicates and benchmark leaks, redact secrets, encode.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the
columns of documents; the last one returns ids. Null and empty texts pass every filter (they hold
nothing to reject); rows with a null id stay. A benchmark or label table without rows rejects nothing.
Decisions on an id hold for all its rows: rows equal in id and text stay or go together. Columns beside
those named pass through every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import byte_bpe, decontaminate, near_dups, secrets, toxicity
from quaystone.llm.common import shared_checkpoint

#: Least score at which a document is dropped as toxic.
REJECT = toxicity.THRESHOLD


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.where(F.col("score") < REJECT).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    dropped = near_dups.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.matches(docs, items).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secrets.redact(secrets.scan(docs, spans="__spans"), spans="__spans")
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast("long"))
    return redacted.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("secrets", redact_secrets), ("byte bpe", encode)]

#: SQL can't express the learnt and sketched stages; tests/llm/test_pipeline.py holds them against known decisions on a small table (no document is toxic there).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what a stage keeps is written to the shared folder once, as the next one reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
