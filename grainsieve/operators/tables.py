"""Tables, figures and procedures of HTML documents as sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.rows import structs

TABLE = r"(?is)<table[^>]*>.*?</table>"
LIST = r"(?is)<ol[^>]*>.*?</ol>"
FIGURE = r"(?is)(?:<[a-z][^>]*>)?\s*\[Figure\s+\d+:\s*.*?\]\s*(?:</[^>]+>)?"
_NUMBERED = r"(?is)\[Figure\s+(\d+):(.*?)\]"
SHOWN = r"(?i)(?:the " + T.any_of("workflow", "figure", "diagram", "chart") + " " + T.any_of("shows", "illustrates", "displays") + r"|as shown)[,:]?\s*(.*?)(?:\.|$)"
STAGES = r"(?i)ha(?:ve|s)\s+(\d+)\s+" + T.any_of("steps?", "stages?", "phases?") + r"[:\s]+(.*?)(?:\.|$)"
_EMPTY = "'none', 'n/a', '-', ''"


def with_heading(c: str, pattern: str, fields: str) -> str:
    """Structs of ``fields`` for the matches ``m`` of a pattern, with ``{heading}``, the last heading before each.

    A heading may stand anywhere before, also around an earlier match, so that each match looks at all of the text before it.
    """
    head = "(?is)<h[1-6](?:" + chr(92) + "s[^>]*)?>(.*?)</h[1-6]>"
    last = lambda m: T.cell(f"try_element_at(regexp_extract_all({m}, {T.quote(head)}, 1), -1)")
    return f"transform({T.matches(c, pattern, whole=True)}, m -> struct({fields.format(heading=f'coalesce({last("m.before")}, {T.quote("")})')}))"


def _cells(c: str, tag: str) -> str:
    return f"transform(regexp_extract_all({c}, {T.quote(f'(?is)<{tag}(?:' + chr(92) + f's[^>]*)?>(.*?)</{tag}>')}, 1), x -> {T.cell('x')})"


def table_type(headers: str, heading: str) -> str:
    h = f"lower(array_join({headers}, ' '))"
    both = f"concat({h}, ' ', lower({heading}))"
    return (
        f"CASE WHEN {both} rlike 'ticket|recent|log|history' OR ({h} rlike 'case' AND {both} rlike 'status|issue|customer') THEN 'log' "
        f"WHEN {both} rlike 'tier|pricing|plan|feature|comparison' THEN 'comparison' WHEN {both} rlike 'resolution|meaning|faq|error|code' THEN 'lookup' ELSE 'data' END"
    )


def tables(docs: DataFrame, *, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """One row a table that has cells: table_no, heading, type, headers, rows, summary, row_texts, content, words_added, original."""
    one = structs(docs, (id_col,), with_heading(html_col, TABLE, "m.ord AS table_no, {heading} AS heading, m.match AS original"), "table_no")
    one = one.withColumn("headers", F.expr(_cells("original", "th")))
    rows = f"filter(transform(regexp_extract_all(original, {T.quote('(?is)<tr(?:' + chr(92) + 's[^>]*)?>(.*?)</tr>')}, 1), r -> {_cells('r', 'td')}), r -> size(r) > 0)"
    one = one.withColumn("rows", F.expr(rows)).where("size(headers) > 0 OR size(rows) > 0").withColumn("type", F.expr(table_type("headers", "heading")))
    few = lambda k: f"lower(array_join(slice(headers, 1, {k}), ', '))"
    one = one.withColumn("summary", F.expr(f"CASE WHEN size(headers) = 0 THEN IF(heading = '', 'Table', heading) WHEN heading = '' THEN 'Table showing ' || {few(4)} ELSE heading || ': ' || {few(4)} END"))
    one = one.withColumn("intro", F.expr(
        "CASE WHEN heading = '' THEN 'Table (' || size(rows) || ' rows):' WHEN type = 'lookup' THEN heading || ' (' || size(rows) || ' entries):' "
        f"WHEN type = 'comparison' THEN heading || ' — comparing ' || size(rows) || ' options by ' || {few(3)} || ':' "
        "WHEN type = 'log' THEN heading || ' — ' || size(rows) || ' entries:' ELSE heading || ' details:' END"))
    part = "transform(r, (v, i) -> IF(lower(v) IN (" + _EMPTY + "), NULL, IF(coalesce(get(headers, i), '') = '', v, headers[i] || ': ' || v)))"
    told = f"filter({part}, x -> x IS NOT NULL)"
    with_head = (
        f"transform(array({told}), p -> CASE WHEN size(p) = 0 THEN NULL WHEN heading <> '' AND r[0] <> '' THEN heading || ' — ' || r[0] || ': ' || array_join(slice(p, 2, size(p)), '. ') || '.' "
        "WHEN heading <> '' THEN heading || ': ' || array_join(p, '. ') || '.' ELSE array_join(p, '. ') || '.' END)[0]"
    )
    bare = "transform(array(array_join(filter(r, x -> x <> ''), ', ')), t -> IF(t = '', NULL, IF(heading = '', '', heading || ': ') || t || '.'))[0]"
    one = one.withColumn("row_texts", F.expr(f"filter(transform(rows, r -> IF(size(headers) > 0, {with_head}, {bare})), x -> x IS NOT NULL)"))
    one = one.withColumn("content", F.expr("intro || '\\n' || array_join(row_texts, '\\n')")).drop("intro")
    return one.withColumn("words_added", F.expr(f"greatest(0, {T.word_count('concat(' + T.quote('[Summary] ') + ', summary, ' + T.quote('. [Content] ') + ', content)')} - {T.word_count(T.cell('original'))})"))


def prompt_rows(headers: str, rows: str) -> str:
    """A table as lines of ``header: value`` for a language model."""
    return f"array_join(filter(transform({rows}, r -> array_join(filter(transform(r, (v, i) -> IF(v = '', NULL, coalesce(get({headers}, i), 'Col' || (i + 1)) || ': ' || v)), x -> x IS NOT NULL), ' | ')), x -> x <> ''), '\\n')"


def figures(docs: DataFrame, *, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """One row a figure reference: figure_no, caption, heading, type, description, confidence, is_gap, summary, content, original."""
    one = structs(docs, (id_col,), with_heading(html_col, FIGURE, "m.ord AS ord, {heading} AS heading, m.match AS original, left(m.after, 600) AS after"), "ord")
    one = one.withColumn("figure_no", F.expr(f"regexp_extract(original, {T.quote(_NUMBERED)}, 1)"))
    one = one.withColumn("caption", F.expr(T.cell(f"regexp_extract(original, {T.quote(_NUMBERED)}, 2)")))
    one = one.withColumn("after", F.expr(T.cell("after"))).withColumn("_w", F.expr(f"array_except({T.words('caption', 3)}, array('figure', 'available', 'not', 'image'))"))
    one = one.withColumn("type", F.expr("CASE WHEN lower(caption) rlike 'flow|process|pipeline|sequence' THEN 'process' WHEN lower(caption) rlike 'chart|graph|trend|revenue|volume|metric' THEN 'chart' WHEN lower(caption) rlike 'diagram|structure|architecture|comparison|tier|overview' THEN 'structure' ELSE 'unknown' END"))
    fits = lambda x: f"({x} <> '' AND (size(_w) = 0 OR arrays_overlap({T.words(x, 3)}, _w)))"
    one = one.withColumn("_a", F.expr(f"trim(regexp_extract(after, {T.quote(SHOWN)}, 0))")).withColumn("_b", F.expr(f"trim(regexp_extract(after, {T.quote(STAGES)}, 0))"))
    near = f"array_join(transform(filter(slice({T.sentences('after', False)}, 1, 4), s -> arrays_overlap({T.words('s', 3)}, _w)), s -> trim(s)), ' ')"
    one = one.withColumn("_c", F.expr(near)).withColumn("description", F.expr(f"CASE WHEN {fits('_a')} THEN _a WHEN {fits('_b')} THEN _b WHEN _c <> '' THEN _c END"))
    one = one.withColumn("is_gap", F.expr("description IS NULL")).withColumn("confidence", F.expr(f"IF({fits('_a')} OR {fits('_b')}, 'high', 'low')"))
    one = one.withColumn("summary", F.expr("'Figure ' || figure_no || ': ' || caption || IF(is_gap, ' (no description)', '')"))
    lost = "IF(contains(lower(caption), 'image not available'), ' (Note: original image not available.)', '')"
    one = one.withColumn("content", F.expr(f"coalesce(description, 'No description available for ' || caption || '.') || {lost}"))
    return one.select(id_col, "ord", "figure_no", "caption", "heading", "type", "description", "confidence", "is_gap", "summary", "content", "original")


def procedures(docs: DataFrame, *, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """One row an ordered list with items: list_no, heading, steps, summary, content, words_added, original."""
    one = structs(docs, (id_col,), with_heading(html_col, LIST, "m.ord AS list_no, {heading} AS heading, right(m.before, 300) AS _b, m.match AS original"), "list_no")
    one = one.withColumn("steps", F.expr(_cells("original", "li"))).withColumn("_b", F.expr(T.cell("_b"))).select(id_col, "list_no", "heading", "steps", "_b", "original")
    one = one.where("size(steps) > 0").withColumn("summary", F.expr("size(steps) || '-step procedure' || CASE WHEN heading <> '' THEN ' for ' || lower(heading) WHEN _b <> '' THEN ': ' || left(_b, 80) ELSE '' END"))
    one = one.withColumn("content", F.expr("array_join(transform(steps, (s, i) -> 'Step ' || (i + 1) || ': ' || s || '.'), ' ')")).drop("_b")
    return one.withColumn("words_added", F.expr(f"greatest(0, {T.word_count('concat(' + T.quote('[Summary] ') + ', summary, ' + T.quote('. [Content] ') + ', content)')} - {T.word_count(T.cell('original'))})"))


def extracted(parts: dict[str, DataFrame], *, id_col: str = "doc_no") -> DataFrame:
    """One row for each table, figure and procedure: kind, ord, heading, summary, words_added, and is_gap for figures without a description."""
    gap = {"figure": F.col("is_gap")}
    place = {"table": "table_no", "figure": "ord", "procedure": "list_no"}
    rows = [
        df.select(id_col, F.lit(k).alias("kind"), F.col(place[k]).alias("ord"), "heading", "summary", (F.col("words_added") if "words_added" in df.columns else F.expr(f"greatest(0, {T.word_count('content')} - {T.word_count(T.cell('original'))})")).alias("words_added"), gap.get(k, F.lit(False)).alias("is_gap"))
        for k, df in parts.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def with_images(figures: DataFrame, images: DataFrame) -> DataFrame:
    """Figures with the path and content of the image of their number, null where there's none; of several images the first by path."""
    one = images.groupBy("figure_no").agg(F.min(F.struct("path", "content")).alias("i")).select("figure_no", F.col("i.path").alias("image_path"), F.col("i.content").alias("image"))
    return figures.join(one, "figure_no", "left")


def normalized(docs: DataFrame, *, id_col: str = "doc_id", html_col: str = "html", parts: dict[str, DataFrame] | None = None) -> DataFrame:
    """``docs`` with tables, figures and procedures rewritten as paragraphs, one a table row; other rows are untouched.

    ``parts`` are the tables, figures and procedures of the documents if they are known already.

    Extractions are gathered by document and put in by place in one pass, never as patterns.
    """
    parts = parts or {"table": tables(docs, id_col=id_col, html_col=html_col), "figure": figures(docs, id_col=id_col, html_col=html_col), "procedure": procedures(docs, id_col=id_col, html_col=html_col)}
    t = parts["table"].select(id_col, F.expr(
        "struct('t' AS kind, table_no AS ord, '<p>' || summary || '.</p>' || array_join(transform(row_texts, r -> '<p>' || r || '</p>'), '') AS new)").alias("x"))
    f = parts["figure"].select(id_col, F.expr("struct('f' AS kind, ord AS ord, '<p>' || summary || '. ' || content || '</p>' AS new)").alias("x"))
    p = parts["procedure"].select(id_col, F.expr("struct('p' AS kind, list_no AS ord, '<p>' || summary || '. ' || content || '</p>' AS new)").alias("x"))
    got = t.unionByName(f).unionByName(p).groupBy(id_col).agg(F.collect_list("x").alias("_x"))
    out = docs.join(got, id_col, "left")
    for kind, pattern in (("t", TABLE), ("f", FIGURE), ("p", LIST)):
        mine = f"map_from_entries(transform(filter(_x, e -> e.kind = '{kind}'), e -> struct(e.ord AS k, e.new AS v)))"
        cut = f"split(regexp_replace({html_col}, {T.quote(pattern)}, '{T.OPEN}$0{T.CLOSE}'), '{T.OPEN}')"
        put = f"transform({cut}, (s, i) -> IF(i = 0, s, coalesce(try_element_at({mine}, i), substring_index(s, '{T.CLOSE}', 1)) || substr(s, locate('{T.CLOSE}', s) + 1)))"
        out = out.withColumn(html_col, F.expr(f"IF(_x IS NULL OR NOT exists(_x, e -> e.kind = '{kind}'), {html_col}, array_join({put}, ''))"))
    return out.select(*docs.columns)
