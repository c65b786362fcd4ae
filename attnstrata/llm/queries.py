"""Registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attnstrata.llm import (
    byte_bpe,
    byte_cnn,
    collocations,
    exact_repeats,
    html_text,
    jaccard_groups,
    language_crf,
    license_scan,
    merkle_manifest,
    pii_spans,
    quality_rules,
    template_leaks,
    url_filter,
)
from attnstrata.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.op1(table(spark, sf_dir, "documents"))


@query
def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op2(table(spark, sf_dir, "documents"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.op3(table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op4(table(spark, sf_dir, "documents"))


ORACLES["op4_quality_rules"] = quality_rules.SQL


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op5(table(spark, sf_dir, "pages"))


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans.op9(table(spark, sf_dir, "documents"))


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_repeats.op11(table(spark, sf_dir, "documents"))


ORACLES["op11_substring_dedup"] = exact_repeats.SQL


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_phrase_collocations"] = collocations.SQL


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.op13(table(spark, sf_dir, "documents"))


ORACLES["op13_merkle_manifest"] = merkle_manifest.SQL
