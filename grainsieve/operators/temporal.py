"""Dates and versions that a text mentions, and how old they and its page are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.vocabulary import MONTH_NAMES, MONTHS

YEARS = (2015, 2030)
MONTH_YEAR = r"(?i)\b(" + MONTH_NAMES + r")\.?\s+(\d{1,2},?\s+)?(\d{4})\b"
QUARTER = r"\bQ([1-4])\s+(\d{4})\b"
ISO = r"\b(\d{4})[-/](\d{2})[-/](\d{2})\b"
PHRASE = r"(?i)\b" + T.any_of("updated", "since", r"last (?:modified|edited)", "from", "effective", "dated", "as of") + r"\s+(" + MONTH_NAMES + r"\.?\s+(?:\d{1,2},?\s+)?\d{4})\b"
VERSION = r"\b[Vv](?:ersion)?\s*(\d+(?:\.\d+)*)\b"
STALE_DAYS = 180


def _all(c: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({c}, {T.quote(pattern)}, {group})"


def dates(c: str, today: str) -> str:
    """Array of (age_months, ord, year, month, raw, type), in order of kind and place; ``today`` is a date expression."""
    month = f"array_position({T.array_of(list(MONTHS))}, left(lower(x['1']), 3))"
    zipped = lambda p, *g: "arrays_zip(" + ", ".join(f"{_all(c, p, k)}" for k in g) + ")"
    mention = lambda year, month, raw, kind: f"struct(CAST(12 * (year({today}) - {year}) + month({today}) - {month} AS int) AS age_months, {year} AS year, CAST({month} AS int) AS month, {raw} AS raw, '{kind}' AS type)"
    a = f"transform({zipped(MONTH_YEAR, 0, 1, 3)}, x -> {mention('CAST(x[' + chr(39) + '2' + chr(39) + '] AS int)', month, 'x[' + chr(39) + '0' + chr(39) + ']', 'month_year')})"
    b = f"transform({zipped(QUARTER, 0, 1, 2)}, x -> {mention('CAST(x[' + chr(39) + '2' + chr(39) + '] AS int)', '(3 * CAST(x[' + chr(39) + '1' + chr(39) + '] AS int) - 2)', 'x[' + chr(39) + '0' + chr(39) + ']', 'quarter')})"
    d = f"transform({zipped(ISO, 0, 1, 2)}, x -> {mention('CAST(x[' + chr(39) + '1' + chr(39) + '] AS int)', 'CAST(x[' + chr(39) + '2' + chr(39) + '] AS int)', 'x[' + chr(39) + '0' + chr(39) + ']', 'iso')})"
    return f"filter(concat({a}, {b}, {d}), x -> x.year BETWEEN {YEARS[0]} AND {YEARS[1]} AND x.month BETWEEN 1 AND 12)"


def page_date(c: str) -> str:
    return f"try_to_date(IF(contains({c}, 'T'), split_part({c}, 'T', 1), left({c}, 10)), 'yyyy-MM-dd')"


def enrich(chunks: DataFrame, today: str, *, content_col: str = "content", modified_col: str | None = "last_modified", stale_days: int = STALE_DAYS) -> DataFrame:
    """``chunks`` with ``dates``, ``newest_date``, ``versions``, ``dated_phrases``, ``page_age_months`` and ``is_stale``.

    ``today`` is an ISO date. Of equally new dates the first counts. A page is stale when older than ``stale_days``, in months; never if that is 0.
    """
    now = f"DATE'{today}'"
    out = chunks.withColumn("dates", F.expr(dates(content_col, now)))
    out = out.withColumn("newest_date", F.expr("get(array_sort(transform(dates, (d, i) -> struct(d.age_months AS age_months, i AS i, d.raw AS raw, d.year AS year, d.month AS month))), 0)"))
    out = out.withColumn("versions", F.expr(_all(content_col, VERSION, 1))).withColumn("dated_phrases", F.expr(_all(content_col, PHRASE, 0)))
    age = f"CAST(12 * (year({now}) - year(_d)) + month({now}) - month(_d) AS int)"
    out = out.withColumn("_d", F.expr(page_date(modified_col) if modified_col else "CAST(NULL AS date)")).withColumn("page_age_months", F.expr(age)).drop("_d")
    return out.withColumn("is_stale", F.expr(f"coalesce(page_age_months > {max(1, stale_days // 30)}, false)" if stale_days > 0 else "false"))


def flag_stale(chunks: DataFrame) -> DataFrame:
    """Stale chunks that are still tagged content are tagged stale."""
    return chunks.withColumn("tag", F.expr("IF(is_stale AND tag = 'content', 'stale', tag)"))


def summary(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count_if(F.expr("size(dates) > 0 OR size(versions) > 0 OR page_age_months IS NOT NULL")).alias("enriched"),
        F.sum(F.size("dates")).alias("total_dates"), F.sum(F.size("versions")).alias("total_versions"), F.count_if("is_stale").alias("stale"),
    )
