"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, classifier, embedding, minhash, mixing, pii, ppm, quality_rules, runindex

LOOSE = 0.42


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"))


def embedding_links_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator under a threshold that the small tables' vectors reach, too."""
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"), LOOSE)


def op4_ppm_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.code_length(_table(spark, sf_dir, "documents"))


def op5_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), number=True)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op9_pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_documents(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_repeated_passages": op2_repeated_passages,
        "op3_embedding_near_dedup": op3_embedding_near_dedup,
        "op4_ppm_code_length": op4_ppm_code_length,
        "op5_bpe_tokens": op5_bpe_tokens,
        "op6_source_mixture": op6_source_mixture,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_chat_format": op8_chat_format,
        "op9_pii_redaction": op9_pii_redaction,
        "op10_quality_rules": op10_quality_rules,
        "embedding_links_loose": embedding_links_loose,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_near_dedup": embedding.links_sql(),
        "embedding_links_loose": embedding.links_sql(LOOSE),
        "op6_source_mixture": mixing.mix_sql(),
        "op8_chat_format": chat.SQL,
        "op10_quality_rules": quality_rules.report_sql(),
    }
