"""The ``opN_`` queries over the given tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acctpulse.llm import (
    ann, importance, merkle, mixing, packing, pieces, pii, preferences, quality, secrets, simhash, site_style, token_file,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents")).drop("text_hash")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.formatted(preferences.answer_pairs(_table(spark, sf_dir, "conversations")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal(_table(spark, sf_dir, "documents")))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_texts(_table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_round_trip(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle.verify(merkle.manifest(docs, merkle.tampered(docs)))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_mix": op3_mix,
    "op4_preferences": op4_preferences,
    "op5_secrets": op5_secrets,
    "op6_personal_data": op6_personal_data,
    "op7_nearest": op7_nearest,
    "op8_packing": op8_packing,
    "op9_main_text": op9_main_text,
    "op10_token_files": op10_token_files,
    "op11_merkle": op11_merkle,
    "op12_importance": op12_importance,
    "op13_pieces": op13_pieces,
}

SQL: dict[str, str] = {
    "op3_mix": mixing.SQL, "op4_preferences": preferences.SQL, "op11_merkle": merkle.SQL, "op12_importance": importance.SQL,
}
