"""Queries of the dealt operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from winnow.llm import (
    decontaminate, divergence, embeddings, fim, language, lines, lm, oracles, personal, quality, secrets, sentencepiece, simhash, sketches,
)

Build = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(table(spark, folder, "documents"))


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_report(table(spark, folder, "documents"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_report(table(spark, folder, "documents"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(table(spark, folder, "documents"))


def op9_embedding_groups(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, folder, "embeddings"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, folder, "documents"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


def op13_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.version_report(table(spark, folder, "documents"))


def queries() -> dict[str, Build]:
    found = (
        op1_secrets, op2_line_dedup, op3_personal_data, op4_sentencepiece, op5_decontamination, op6_language, op7_quality,
        op8_language_model, op9_embedding_groups, op10_simhash, op11_fill_in_middle,
        op12_source_divergence, op13_document_fingerprints,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": oracles.OP2,
        "op5_decontamination": oracles.OP5,
        "op9_embedding_groups": oracles.OP9,
        "op11_fill_in_middle": oracles.OP11,
        "op12_source_divergence": oracles.OP12,
    }
