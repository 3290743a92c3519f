"""Queries of the training-data operators, and the SQL that must give the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from armlift.llm import (
    bpe, collocations, exact_dedup, fingerprints, html_text, line_rules, near_dedup, packing, quality_model, source_audit,
    token_counts, token_files, url_filter,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, ALLOW, BLOCK).drop("url")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, folder, "documents"))


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_groups(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_model.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return found.drop("text_hash")


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read_tokens(token_files.write_tokens(_table(spark, folder, "documents")))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, folder, "documents"))


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(_table(spark, folder, "pages"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge(_table(spark, folder, "documents")).drop("text_hash")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.verdicts(_table(spark, folder, "documents"))


def op13_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audit(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_bpe, op3_near_dedup, op4_quality, op5_token_files, op6_token_counts, op7_fingerprints,
    op8_html_text, op9_quality_rules, op10_packing, op11_collocations, op12_exact_dedup, op13_source_audit,
)}
CHECKS: dict[str, str] = {
    "op1_url_filter": url_filter.check_sql(ALLOW, BLOCK),
    "op3_near_dedup": near_dedup.check_sql(),
    "op11_collocations": collocations.check_sql(),
    "op12_exact_dedup": exact_dedup.check_sql(),
    "op13_source_audit": source_audit.check_sql(),
}
