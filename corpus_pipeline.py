"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. Its result is written as
Parquet and read again as the next stage's ``docs``, so a lost executor never reaches back beyond a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acctpulse.llm import mixing, packing, quality, secrets, simhash
from acctpulse.session import work_path


def sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail a base rule nor lie far from the bulk of their language and source."""
    return quality.keep_sound(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, a row per piece of a document, with its token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", sound),
    ("SimHash near-dedup", distinct),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

# Fingerprints, the network and the tokenizer are beyond SQL; tests/llm/test_pipeline.py checks the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
