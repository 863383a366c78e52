"""The corpus pipeline: toxicity, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first three
return the columns of documents; the last returns the packing plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import near_dedup, packing, secrets, toxicity
from logloom.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies of this stage: five-word shingles, linked from a similarity of 0.8 on.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs, words=WORDS, percent=PERCENT)
    gone = written(found.where("not kept").select("doc_id").distinct())
    if gone.count() <= near_dedup.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = secrets.redact(docs.select(*COLUMNS))
    return changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack)]

#: The first stage is a trained model, which SQL can't express; tests compare the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
