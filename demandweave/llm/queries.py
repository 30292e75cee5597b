"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandweave.llm import (
    chat_format, decontamination, exact_substrings, filter_audit, language_id, license_scan, line_dedup, order_minhash, packing,
    quality_classifier, quality_rules, url_filters, vector_codes,
)
from demandweave.llm.url_filters import UrlRule

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_substrings.dedup_substrings(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_exclamations", "n_capitals", "n_stop_words", "n_lines", "broken_rules")


# Rules of the query.
URL_RULES = (
    UrlRule("org", "/", "allow"), UrlRule("example.org", "/es/", "block"), UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"), UrlRule("com", "/de/", "block"),
)
# Host names that put a URL on the list.
LISTED_HOSTS = r"(^|\.)(cheap-pills|spam-farm|adult-x)\."


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The list: the URLs of pages with a listed host name."""
    pages = _table(spark, folder, "pages").select("page_id", "url")
    listed = pages.filter(url_filters.host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return url_filters.judge_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, folder, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    leaks = decontamination.with_leaks(docs, _table(spark, folder, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.*")


def op8_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    chosen, rejected = chat_format.swapped_replies(_table(spark, folder, "conversations"))
    return chat_format.preference_segments(chosen, rejected)


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    marked = line_dedup.dedup_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, folder, "documents").select("doc_id", "text", "lang"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    return filter_audit.audit_filters(docs, _table(spark, folder, "labels"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress_vectors(_table(spark, folder, "embeddings"))
    return coded.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def queries() -> dict[str, Query]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
