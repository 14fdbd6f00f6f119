"""The numbered queries over the test tables, and the check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import collocations, contamination, exact, extraction, katz, langid, neardup, packing, quality, secrets, substrings, suffixes, whitening
from tidewatch.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return langid.predict_languages(docs, langid.fit_languages(docs))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeat_report(read_table(spark, folder, "documents"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.string_report(read_table(spark, folder, "documents"))


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_main_text(read_table(spark, folder, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, folder, "documents")).drop("text_hash")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, folder, "documents"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, read_table(spark, folder, "labels")))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, folder, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contamination_report(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    )


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitening_report(read_table(spark, folder, "embeddings"))


def op12_katz_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score_report(read_table(spark, folder, "documents"))


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))


REGISTRY: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_substring_dedup,
        op3_best_fit_packing,
        op4_suffix_array_dedup,
        op5_html_extraction,
        op6_minhash_near_dedup,
        op7_secret_scan,
        op8_quality_classifier,
        op9_exact_dedup,
        op10_benchmark_decontamination,
        op11_embedding_whitening,
        op12_katz_scoring,
        op13_phrase_collocations,
    )
}
ORACLES: dict[str, str] = {"op9_exact_dedup": exact.ORACLE, "op13_phrase_collocations": collocations.ORACLE}
