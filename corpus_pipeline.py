"""From raw documents to token ids, in five stages.

Each stage works on all that the one before kept; what it returns is written as Parquet in the
shared folder and read again. The first four return the columns of ``documents``.

All stages take rows with nulls in any column, empty and very long texts, repeated rows, ids of any type, further
columns of any name (which the first four pass on) and an empty table, which gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.llm import decontaminate, jaccard, pieces, pii, toxicity
from grainsieve.llm.store import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic spans; the model is fitted on labelled ones among them.

    Null, empty and wordless texts stay, and each of repeated rows is judged alike. Without a toxic and a clean label all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates, and all others.

    Rows of null id and texts without words are like no other and stay. Of rows that repeat both id and text one stays;
    rows that repeat an id with another text are one document, and stay or go together.
    """
    extra = jaccard.near_duplicates(docs).where("doc_id <> group_id").select("doc_id")
    kept = docs.join(extra, "doc_id", "left_anti").select(*docs.columns)
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_anti")
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null, empty and short texts contain none; repeated rows are judged alike."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and ``n_chars`` counted anew; null texts stay null, with a null ``n_chars``. Repeated rows count as often as they occur."""
    return pii.sanitise(docs, counts=False).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with whether they decode to the text; null and empty texts have none. One row for each."""
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", sanitise),
    ("sentencepiece", encode),
]

#: Trained models and piece tables can't be had in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
