"""Documents from memory and from files; test sets and results as files.

A document is (doc_id, title, text, metadata map). Files are read by Spark on the executors.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCHEMA = "doc_id string, title string, text string, metadata map<string,string>"
SUFFIXES = ("html", "htm", "txt", "md", "docx", "pdf")
TEST_SET = "id string, category string, question string, ground_truth string, ground_truth_reason string, expected_behavior string, issue_ref string, review_note string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def from_any(spark: SparkSession, data: str | dict | list | DataFrame) -> DataFrame:
    """Documents of a text, a dict with text and perhaps id, title, metadata, a list of either, or a DataFrame. Items of a list that are neither are left out."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, (str, dict)):
        data = [data]
    if not isinstance(data, list):
        raise ValueError(f"documents can't be made of {type(data).__name__}")
    rows = []
    for k, d in enumerate(data, 1):
        if isinstance(d, str):
            d = {"text": d}
        if isinstance(d, dict):
            rows.append((str(d.get("id") or f"doc_{k}"), d.get("title") or "", d.get("text") or "", {a: str(b) for a, b in (d.get("metadata") or {}).items()}))
    return spark.createDataFrame(rows, SCHEMA)


def docx_html(content: bytes) -> str:
    """Paragraphs of a Word document as HTML: headings by the name of their style."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"(?:Heading|heading )\s?([1-4])|(Title)", style.get(f"{_W}val", "")) if style is not None else None
        tag = f"h{level[1] or 1}" if level else "p"
        if text:
            out.append(f"<{tag}>{text}</{tag}>")
    return "\n".join(out)


def pdf_text(content: bytes) -> str:
    """Texts of the pages of a PDF, by PyMuPDF if it's installed; else ImportError."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return "\n\n".join(t for p in doc if (t := p.get_text().strip()))


def _decoded(suffix: str, content: bytes) -> str:
    return docx_html(content) if suffix == "docx" else pdf_text(content) if suffix == "pdf" else content.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def _strict(suffixes: pd.Series, contents: pd.Series) -> pd.Series:
    return pd.Series([_decoded(s, bytes(c)) for s, c in zip(suffixes, contents)], dtype=object)


@F.pandas_udf(StringType())
def _lenient(suffixes: pd.Series, contents: pd.Series) -> pd.Series:
    def read(s: str, c: bytes) -> str | None:
        try:
            return _decoded(s, c)
        except Exception:  # a file that can't be read is skipped, as asked for
            return None

    return pd.Series([read(s, bytes(c)) for s, c in zip(suffixes, contents)], dtype=object)


def _read(spark: SparkSession, path: str, pattern: str | None, metadata: dict[str, str] | None, strict: bool) -> DataFrame:
    reader = spark.read.format("binaryFile")
    raw = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    name, suffix = F.element_at(F.split("path", "/"), -1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.when(suffix.isin("docx", "pdf"), (_strict if strict else _lenient)(suffix, "content")).otherwise(F.decode("content", "UTF-8"))
    own = F.create_map(F.lit("source_path"), F.regexp_replace("path", "^file:/+", "/"), F.lit("file_type"), suffix, F.lit("last_modified"), F.date_format("modificationTime", "yyyy-MM-dd"))
    more = F.create_map(*[F.lit(str(x)) for kv in (metadata or {}).items() for x in kv]) if metadata else F.expr("CAST(map() AS map<string,string>)")
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(more), k)), more)
    return raw.select(name.alias("doc_id"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), text.alias("text"), merged.alias("metadata")).where("text IS NOT NULL")


def load_file(spark: SparkSession, path: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """One document. FileNotFoundError without the file, ValueError for a suffix that isn't read."""
    if "://" not in path and not os.path.isfile(path):
        raise FileNotFoundError(path)
    if path.rsplit(".", 1)[-1].lower() not in SUFFIXES:
        raise ValueError(f"can't read files like {path}")
    return _read(spark, path, None, metadata, True)


def load_directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = SUFFIXES, metadata: dict[str, str] | None = None) -> DataFrame:
    """The documents of a folder, without its folders; suffixes in any case; files that can't be read are skipped."""
    any_case = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    pattern = "*.{" + ",".join(any_case(e.lstrip(".")) for e in extensions) + "}"
    return _read(spark, path, pattern, metadata, False)


def figure_images(spark: SparkSession, path: str) -> DataFrame:
    """(figure_no, path, content): images named figure1_x.png, figure_1_x.png or fig1_x.png."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "fig*.{png,jpg,jpeg,gif,webp,svg}").load(path)
    no = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(?:figure_?|fig)(\d+)_", 1)
    return raw.select(no.alias("figure_no"), "path", "content").where("figure_no <> ''")


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a CSV file with a header; fields may span lines."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_test_set(questions: DataFrame, path: str) -> None:
    questions.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_results(tables: dict[str, DataFrame], path: str, form: str = "json") -> None:
    """Each table in a folder of its own, as JSON lines or Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")


class PhaseCache:
    """Tables of a phase, kept as Parquet under a key of the whole input."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def key(text: str) -> str:
        import hashlib

        return hashlib.md5(text.encode()).hexdigest()[:12]

    def _at(self, key: str, phase: str) -> str:
        return f"{self.path}/{key}/{phase}"

    def _fs(self, key: str, phase: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(key, phase))
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def save(self, key: str, phase: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._at(key, phase))
        return self.load(key, phase)

    def has(self, key: str, phase: str) -> bool:
        fs, p = self._fs(key, phase)
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))

    def load(self, key: str, phase: str) -> DataFrame:
        return self.spark.read.parquet(self._at(key, phase))

    def age_seconds(self, key: str, phase: str) -> float:
        import time

        fs, p = self._fs(key, phase)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def clear(self, key: str, phase: str) -> None:
        fs, p = self._fs(key, phase)
        fs.delete(p, True)


def call_model(df: DataFrame, prompt: str, answer: str, call, partitions: int | None = None) -> DataFrame:
    """``df`` with the answers of ``call`` (text to text) to a column of prompts; at most ``partitions`` calls at a time. Null where a prompt is null or a call fails."""
    columns = [c for c in df.columns if c != answer]

    def ask(p: str | None) -> str | None:
        try:
            return call(p) if p is not None else None
        except Exception:  # the rules' result stands where a model fails
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pa.array([ask(p) for p in batch.column(prompt).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, said], names=[*columns, answer])

    source = df.select(*columns) if partitions is None else df.select(*columns).repartition(partitions)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{fields}, `{answer}` string")


def embed(df: DataFrame, text: str, into: str, call, batch: int = 50) -> DataFrame:
    """``df`` with vectors of a column of texts, by ``call`` (a list of texts to a list of vectors) in batches; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(text).to_pylist()
            known = [t for t in texts if t is not None]
            vectors = iter([v for k in range(0, len(known), batch) for v in call(known[k : k + batch])])
            out = pa.array([None if t is None else [float(x) for x in next(vectors)] for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, out], names=[*rows.schema.names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{into}` array<float>")
