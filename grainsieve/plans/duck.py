"""Pieces of the DuckDB SQL that results are compared with."""

from __future__ import annotations

from grainsieve.functions import text as T
from grainsieve.plans.corpus import HTML_SQL, KB_SQL

WITH_KB = f"WITH kb AS ({KB_SQL.replace('STRING', 'VARCHAR')})"
WITH_HTML = f"{WITH_KB}, page AS ({HTML_SQL.replace('STRING', 'VARCHAR')})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sub(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def squeeze(c: str) -> str:
    return f"trim({sub(c, T.SPACE + '+', ' ')})"


def plain(c: str) -> str:
    for pattern, by in ((r"(?i)</(?:div|h[1-6]|li|p|tr)>", ". "), (r"<[^>]+>", " "), (r":[\s]*\.", ":"), (r"\.([\s]*\.)+", ".")):
        c = sub(c, pattern, by)
    return squeeze(c)


def cell(c: str) -> str:
    return squeeze(sub(c, "<[^>]+>", " "))


def parts(c: str, pattern: str) -> str:
    return f"list_filter(string_split_regex({c}, {q(pattern)}), lambda x: x <> '')"


def word_count(c: str) -> str:
    return f"len({parts(c, T.SPACE + '+')})"


def words(c: str, least: int) -> str:
    return f"list_filter(string_split_regex(lower({c}), {q(T.NOT_WORD)}), lambda x: regexp_full_match(x, '[a-z]{{{least},}}'))"


def sentences(c: str, upper: bool = False) -> str:
    """By marking the cuts: there is no looking around here."""
    if upper:
        return f"string_split({sub(c, '([.!?])' + T.SPACE + '+([A-Z])', chr(92) + '1' + chr(1) + chr(92) + '2')}, chr(1))"
    return f"string_split({sub(c, '([.!?])' + T.SPACE + '+', chr(92) + '1' + chr(1))}, chr(1))"


def matches(source: str, keys: str, c: str, pattern: str) -> str:
    """A table: keys, ord, m, before, after."""
    marked = f"string_split(regexp_replace({c}, {q(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    return f"""(SELECT {keys}, i - 1 AS ord, string_split(p[i], chr(2))[1] AS m, replace(array_to_string(p[1:i-1], ''), chr(2), '') AS before,
  replace(string_split(p[i], chr(2))[2] || array_to_string(p[i+1:], ''), chr(2), '') AS after
  FROM (SELECT {keys}, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT {keys}, {marked} AS p FROM {source})))"""


def evidence(most: int = 150) -> str:
    return f"""left(trim(regexp_extract(before, '[^.!?\\n]*\\z') || m || regexp_extract(after, '^[^.!?\\n]*[.!?]?')), {most})"""
