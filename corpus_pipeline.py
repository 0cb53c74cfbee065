"""A training corpus from `documents`: quality rules, near-duplicates, benchmark passages, secrets, and the mixture.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; the last returns the mixture, its rows numbered by `copy`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, mixing, quality_rules, secret_scan, simhash
from sparkloom.llm.common import content_key, cut, drop, shared_dir, split_rows, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are told apart by id, text, language and source, from which verdicts follow.

    Null, empty and short texts go, as the base rule has it; long ones are judged whole; repeated rows share their verdict.
    """
    key = content_key("doc_id", "text", "lang", "source")
    slim = docs.select("text", "lang", "source", key.alias("_key"))
    gone = quality_rules.judge(slim, row="_key").filter(~F.col("kept")).select("_key").distinct()
    return split_rows(docs, key, cut(gone))[1]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group: of the least id (null last), of repeated rows one.

    Null and empty texts are one group; texts of any length are compared whole.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without the long benchmark passages some still hold.

    Null and empty texts stay as they are; rows are judged one by one, whatever their ids.
    """
    return _recounted(docs, decontaminate.remove(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; null and empty texts as they are, repeated rows alike."""
    return _recounted(docs, secret_scan.redact(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each copy. Texts without words have no part in any target."""
    return mixing.repeat(docs)


def _recounted(docs: DataFrame, new: DataFrame) -> DataFrame:
    """new with n_chars as its texts now have it, where the table counts characters."""
    if "n_chars" not in docs.columns:
        return new
    return new.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]

#: The first stage's iterated estimates and the second's bits of hashes aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:
            drop(spark, f"{home}/{k - 1}")
    return docs
