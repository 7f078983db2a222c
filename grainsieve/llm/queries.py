"""Queries and SQL of the operators of this subpackage, over the whole tables of a folder.

What nulls, empty and long texts, ties, repeated rows, empty tables and further columns give is stated in the module of
each operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainsieve.llm import decontaminate, html, jaccard, langid, neighbours, pieces, pii, substrings, suffixes, toxicity


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows, of all rows, of each whose id is divisible by 50."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asked="vec_id % 50 = 0")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that another document has too, as word positions."""
    return substrings.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without what other pages of its host repeat."""
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with near duplicates and their groups."""
    return jaccard.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, with whether they decode to its text."""
    return pieces.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with toxic spans, after a model of the labelled ones."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxic_documents(docs, labels)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and language of every document, after machines fitted on a sample of each language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return langid.identify(docs, langid.train(docs))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they contain."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(docs, items)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced and what gives it away generalised or removed."""
    return pii.sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that another document has too, as word positions."""
    return suffixes.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_pii": op9_pii,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

ORACLES: dict[str, str] = {"op2_substring_dedup": substrings.ORACLE, "op4_ngram_jaccard_join": jaccard.ORACLE, "op8_benchmark_decontamination": decontaminate.ORACLE, "op10_suffix_array_dedup": substrings.ORACLE}
