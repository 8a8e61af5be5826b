"""A cleaning pipeline over `documents`: language, near duplicates, benchmark leaks, secrets, packing.

STAGES are applied in order; each takes what its predecessor kept, written as Parquet and read again,
and all but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwright.llm import common, decontaminate, language, neardup, packing, secrets


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language, and sets it."""
    common.release(spark)
    return language.accepted(docs, language.learned(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates."""
    common.release(spark)
    return neardup.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item."""
    common.release(spark)
    return decontaminate.decontaminated(docs, common.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts, whose number of characters follows."""
    common.release(spark)
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in sequences of the model's length."""
    common.release(spark)
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("decontamination", decontaminate_benchmark), ("secrets", redact_secrets), ("packing", pack)]

#: Sequences of learned labels and tokenizers' ids can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`."""
    docs = common.read(spark, sf_dir, "documents")
    root = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{k}-{name}")
            docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
