"""Documents that keep arriving: findings and cleaned chunks with a frozen context, and vocabulary by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainsieve.functions import text as T
from grainsieve.functions.vocabulary import COMMON_CORPUS
from grainsieve.operators import clarity, governance, temporal
from grainsieve.operators.domain import Context


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long", files_at_once: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def cleaned(docs: DataFrame, context: Context, today: str, *, text_col: str = "text") -> DataFrame:
    """Documents as chunks after dates, clarity and governance: no state, no shuffle."""
    chunks = docs.withColumnRenamed(text_col, "content").withColumn("heading", F.lit(""))
    chunks = temporal.enrich(chunks, today, modified_col=None)
    chunks = clarity.fix(clarity.with_findings(chunks, context), context)
    return governance.clean(governance.with_findings(chunks))


def word_counts(docs: DataFrame, *, time_col: str, late: str = "1 hour", window: str = "10 minutes", text_col: str = "text") -> DataFrame:
    """Word frequencies by window of arrival; what is later than ``late`` is dropped, so that state stays bounded."""
    words = docs.withWatermark(time_col, late).select(F.window(time_col, window).alias("window"), F.explode(F.expr(T.words(text_col, 4))).alias("word"))
    return words.where(~F.col("word").isin(COMMON_CORPUS)).groupBy("window", "word").agg(F.count("*").alias("n"))


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there to Parquet and ends; the checkpoint remembers what was read."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
