"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontam, licenses, linededup, pieces, quality, sharding, simhash, substring, tokenbin, warc
from leafmill.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenbin.read(*tokenbin.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(*warc.write(table(spark, sf_dir, "pages"))).drop("payload")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_benchmark_decontamination, op3_sharding, op4_token_id_output, op5_license_scan,
        op6_sentencepiece, op7_line_dedup, op8_warc, op9_substring_dedup, op10_simhash,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE, "op2_benchmark_decontamination": decontam.ORACLE, "op3_sharding": sharding.ORACLE,
    "op5_license_scan": licenses.ORACLE, "op8_warc": warc.ORACLE, "op9_substring_dedup": substring.ORACLE,
}
