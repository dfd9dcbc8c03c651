"""Registered queries of the operators, and their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_extract, jaccard_join, license_scan, mixing, periodic_runs, quality_rules, substring_dedup, suffix_dedup, token_alignment, url_filters, warc
from .common import table


def op1_chat_formatting(spark: SparkSession, directory: str) -> DataFrame:
    turns = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    conv, text = chat.PROBE
    probe = spark.createDataFrame(
        [(conv, 0, "user", text), (conv, 1, chat.TRAINED_ROLE, text)], "conv_id long, turn long, role string, text string"
    )
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


def op2_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return substring_dedup.dedup_words(table(spark, directory, "documents"))


def op3_html_extraction(spark: SparkSession, directory: str) -> DataFrame:
    return html_extract.extract(table(spark, directory, "pages"))


def op4_source_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mix(table(spark, directory, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, directory, "documents"))


def op6_warc(spark: SparkSession, directory: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, directory, "pages"))
    return index.selectExpr(
        "page AS page_id", "bytes AS payload_bytes", "digest AS payload_digest", "type AS record_type", "refers AS refers_to"
    )


def op7_benchmark_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return decontaminate.judge(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op8_url_filters(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages")
    return url_filters.filter_urls(pages, url_filters.page_outcomes(pages, table(spark, directory, "labels")))


def op9_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    return quality_rules.measure(table(spark, directory, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, directory, "documents"), width=4, percent=85)


def op11_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return license_scan.scan(table(spark, directory, "documents"))


def op12_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    return periodic_runs.detect(table(spark, directory, "documents"), mark=periodic_runs.crc_mark)


def op13_token_alignment(spark: SparkSession, directory: str) -> DataFrame:
    return token_alignment.align_corpus(table(spark, directory, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_substring_dedup, op3_html_extraction, op4_source_mixing, op5_suffix_array_dedup, op6_warc, op7_benchmark_decontamination, op8_url_filters, op9_quality_rules, op10_ngram_jaccard_join, op11_license_scan, op12_periodic_runs, op13_token_alignment)}

ORACLE = {
    "op1_chat_formatting": chat.oracle(),
    "op2_substring_dedup": substring_dedup.oracle(),
    "op4_source_mixing": mixing.oracle(),
    "op6_warc": warc.oracle(),
    "op7_benchmark_decontamination": decontaminate.oracle(),
    "op8_url_filters": url_filters.oracle(),
    "op9_quality_rules": quality_rules.oracle(),
    "op10_ngram_jaccard_join": jaccard_join.oracle(4, 85),
    "op11_license_scan": license_scan.oracle(),
    "op12_periodic_runs": periodic_runs.oracle(),
}
