"""Sections of HTML documents and their headings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from grainsieve.functions import text as T
from grainsieve.functions.rows import structs

_HEAD_ANY = r"(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>"
_CUT = "\u0003"
_MORE = r"\s*(?:info(?:rmation)?)?"
GENERIC = r"(?i)^" + T.any_of(
    "various", "updates?", "untitled", "stuff", r"section\s*\d+", "random", r"part\s*\d+", "overview", "other", "notes?", "more" + _MORE, "misc(?:ellaneous)?",
    "general", "extra", "details", "content", "appendix", "additional" + _MORE) + r"\s*$"
_VERB = T.any_of("supports?", "provides?", "processes?", "manages?", "handles?", "covers?")
SUBJECT = rf"(?i)\w+\s+{_VERB}\s+(?:all\s+)?(.{{5,40}}?)(?:\s+" + T.any_of("including", "for", "and", "across") + r"|[.,;]|$)"
ABOUT = r"(?i)" + T.any_of("regarding", "for", "explains?", "describes?", "covers?", "about") + r"\s+(.{10,60}?)(?:[.,;]|$)"
LEAST_WORDS = 10
STOP_HEADING = sorted("""
your you will with who which where when what was very via use to those this they these there them their then the that than some should see per our or on of not
need must most more may make just its it into is in if how here have has from for every each contact check can by but being been be at are any and an also all a
available we were out take get
""".split())


def sections(c: str) -> str:
    """Array of (section_no, heading, level, content, words, is_orphan): what follows each heading, without empty ones."""
    parts = f"split({T.replace(c, _HEAD_ANY, _CUT + '$0')}, '{_CUT}')"
    found = lambda g: f"regexp_extract(p, {T.quote('(?is)^<h([1-6])(?:' + chr(92) + 's[^>]*)?>(.*?)</h[1-6]>')}, {g})"
    body = f"trim({T.replace('p', '(?is)^<h[1-6](?:' + chr(92) + 's[^>]*)?>.*?</h[1-6]>', '')})"
    heading = f"trim({T.replace(found(2), '<[^>]+>', '')})"
    one = f"transform({parts}, p -> named_struct('heading', {heading}, 'level', coalesce(try_cast({found(1)} AS int), 0), 'content', {body}))"
    words = T.word_count(T.cell("s.content"))
    kept = f"filter(transform({one}, s -> struct(s.*, {words} AS words)), s -> s.words > 0)".replace("struct(s.*,", "struct(s.heading AS heading, s.level AS level, s.content AS content,")
    return f"transform({kept}, (s, i) -> struct(i AS section_no, s.heading AS heading, s.level AS level, s.content AS content, s.words AS words, s.level = 0 AND s.heading = '' AS is_orphan))"


def is_generic(h: str) -> str:
    bare = f"trim({T.replace('trim(' + h + ')', ':+' + chr(92) + 's*$', '')})"
    return f"({bare} = '' OR {bare} rlike {T.quote(GENERIC)} OR ({T.word_count(bare)} = 1 AND length({bare}) < 5))"


def _ranked(text: str | None, k: int) -> str:
    import re

    words = [w for w in re.findall(r"\b[a-z]{3,}\b", (text or "").lower()) if w not in _STOP]
    return " ".join(w.capitalize() for w, _ in Counter(words).most_common(k))  # ties by first place


_STOP = frozenset(STOP_HEADING)


@F.pandas_udf(StringType())
def frequent_words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The three most frequent words of each text, in capitals."""
    for t in texts:
        yield t.map(lambda x: _ranked(x, 3))


def named_sections(docs: DataFrame, *, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """One row a section: what ``sections`` has, and ``new_heading``, ``heading_source``, ``original_heading``, ``is_generic``, ``new_level``.

    Sections of ten or more words without a heading, or with one that says nothing, get one from their text: the object of
    its first verb of handling, what it's about, its most frequent words or its first ones.
    """
    rows = structs(docs, (id_col,), sections(html_col), "section_no")
    rows = rows.withColumn("is_generic", F.expr(f"NOT is_orphan AND words >= {LEAST_WORDS} AND {is_generic('heading')}"))
    rows = rows.withColumn("_fix", F.expr(f"words >= {LEAST_WORDS} AND (is_orphan OR is_generic)")).withColumn("_clean", F.expr(f"IF(_fix, {T.cell('content')}, NULL)"))
    first = f"array_join(slice({T.sentences('_clean', False)}, 1, 2), ' ')"
    rows = rows.withColumn("_first", F.expr(first))
    rows = rows.withColumn("_a", F.expr(f"trim({T.replace(f'trim(regexp_extract(_first, {T.quote(SUBJECT)}, 1))', '[.,;:]+$', '')})"))
    rows = rows.withColumn("_b", F.expr(f"trim({T.replace(f'trim(regexp_extract(_first, {T.quote(ABOUT)}, 1))', '[.]+$', '')})"))
    rows = rows.withColumn("_c", F.expr(f"IF(_a <> '' AND {T.word_count('_a')} <= 5, {T.first_upper('_a')}, IF(_b <> '', {T.first_upper('_b')}, NULL))"))
    rows = rows.withColumn("_d", F.when(F.col("_fix") & F.col("_c").isNull(), frequent_words("_clean")))
    early = f"array_join(slice(filter(slice({T.pieces('_clean', T.SPACE + '+')}, 1, 15), w -> length(w) > 2 AND NOT array_contains({T.array_of(STOP_HEADING)}, {T.replace('lower(w)', '[.,;:]+$', '')})), 1, 4), ' ')"
    rows = rows.withColumn("_e", F.expr(T.first_upper(T.replace(early, '[.,;:]+$', ''))))
    rows = rows.withColumn("_new", F.expr("IF(_fix, coalesce(_c, nullif(_d, ''), nullif(_e, '')), NULL)"))
    return rows.select(
        id_col, "section_no", F.coalesce("_new", "heading").alias("new_heading"), F.expr("IF(is_generic, heading, '')").alias("original_heading"),
        F.expr("CASE WHEN _new IS NULL THEN 'original' WHEN is_generic THEN 'replaced' ELSE 'generated_rule' END").alias("heading_source"),
        F.expr("IF(_new IS NOT NULL AND level = 0, 2, level)").alias("new_level"), "level", "heading", "content", "words", "is_orphan", "is_generic",
    )


def summary(named: DataFrame) -> DataFrame:
    """Detected and resolved headings, words in and out."""
    fixed = F.col("heading_source") != "original"
    return named.agg(
        F.count_if((F.col("words") >= LEAST_WORDS) & (F.col("is_orphan") | F.col("is_generic"))).alias("detected"), F.count_if(fixed).alias("resolved"),
        F.sum("words").alias("words_in"), F.sum(F.col("words") + F.when(fixed, F.expr(T.word_count("new_heading"))).otherwise(0)).alias("words_out"),
    )
