"""The corpus operators as registered queries, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thermobox.llm import (
    hard_negatives, language_id, license_scan, line_quality, log_bilinear, near_dedup, pii, quality_rules, source_mix,
    target_resampling, token_packing, vector_search, warc_bundles,
)
from thermobox.llm.common import table, tokenizer_file


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op1(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.op2(table(spark, sf_dir, "documents"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.op3(table(spark, sf_dir, "pages"))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.op4(table(spark, sf_dir, "embeddings"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op5(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.op6(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op8(table(spark, sf_dir, "documents"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op8 on pages, which have markup and addresses."""
    return language_id.identify_pages(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op12(table(spark, sf_dir, "embeddings"))


def op13_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mix": op2_source_mix,
    "op3_warc_bundles": op3_warc_bundles,
    "op4_vector_search": op4_vector_search,
    "op5_near_dedup": op5_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_quality": op7_line_quality,
    "op8_language_id": op8_language_id,
    "page_languages": page_languages,
    "op9_pii": op9_pii,
    "op10_license_scan": op10_license_scan,
    "op11_target_resampling": op11_target_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_log_bilinear": op13_log_bilinear,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_source_mix": source_mix.SQL,
    "op10_license_scan": license_scan.oracle(),
    "op11_target_resampling": target_resampling.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
