"""Wording that a reader of a single chunk can't resolve, and its repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.rows import structs
from grainsieve.functions.vocabulary import EVERYDAY_ACRONYMS, NOT_ACRONYMS_IN_TEXT
from grainsieve.operators.domain import Context

MOST_WORDS = 40
_START = r"(?m)(?:^|[.!?]\s+)" + T.any_of("Those", "These", "They", "Them", "Their", "That", "This", "It") + r"\s"
_THEY = r"(?i)\b(?:their|them|they)\b"
_LAST_THEY = r"(?is)^.*\b(their|them|they)\b"
VAGUE = r"(?i)\bthe " + T.any_of("tool", "team", "system", "service", "platform", "group", "department", "application") + r"\b"
REFERENCE = r"(?i)" + T.any_of(
    "the above", "see previous", f"refer(?:red)? to {T.any_of('the previous', 'earlier', 'above')}", "mentioned earlier", f"as {T.any_of('noted', 'mentioned', 'described', 'above')}")
_EXPANDED = r"([A-Z]+)\s*\([A-Z][a-z]"
_NUMBERED = r"(?m)^(\d+)[.)]\s"
_STEP = r"Step (\d+):"
#: Before a pattern: what a match begins with. One look at a character is faster than a word border or several phrases; results are the same.
_T_FIRST, _START_FIRST, _REFERENCE_FIRST, _CAPITAL_FIRST = "(?=[Tt])", "(?=[.!?TI])", "(?=[TtSsRrMmAa])", "(?=[A-Z]{2})"
_FINDING = "struct<issue:string,term:string,evidence:string,proposal:string,confident:boolean>"


def _struct(issue: str, term: str, evidence: str, proposal: str = "''", confident: str = "false") -> str:
    return f"named_struct('issue', '{issue}', 'term', {term}, 'evidence', {evidence}, 'proposal', {proposal}, 'confident', {confident})"


def pronouns(c: str, heading: str, ctx: Context) -> str:
    who, sure = subject(heading, ctx)
    bare = f"trim({T.replace('m.match', '^[.!?]?' + chr(92) + 's*', '')})"
    proposed = f"IF({sure}, {who}, '')"
    start = f"transform({T.matches(c, _START_FIRST + _START)}, m -> {_struct('pronoun', bare, T.evidence('m'), proposed, sure)})"
    # sentences with their ends, each looked at once: a pattern over a whole sentence would begin anew at each of its characters
    ended = f"filter(split({c}, '(?<=[.!?])'), s -> s rlike {T.quote(_T_FIRST + _THEY)} AND right(s, 1) IN ('.', '!', '?'))"
    mid = f"IF({c} rlike {T.quote(_T_FIRST + _THEY)}, transform({ended}, s -> {_struct('pronoun', f'lower(regexp_extract(s, {T.quote(_LAST_THEY)}, 1))', 'left(trim(s), 100)', proposed, sure)}), CAST(array() AS array<{_FINDING}>))"
    return T.first_of_each(f"concat({start}, {mid})", "lower(x.term)")


def subject(heading: str, ctx: Context) -> tuple[str, str]:
    """Who a pronoun stands for, judged by the heading, and whether that is sure: the first actor or else product that it names."""
    actor = f"get(filter({T.array_of(ctx.actors)}, a -> contains(lower({heading}), lower(a))), 0)" if ctx.actors else "CAST(NULL AS string)"
    product = f"get(filter({T.array_of(ctx.products)}, a -> contains(lower({heading}), lower(a))), 0)" if ctx.products else "CAST(NULL AS string)"
    return f"coalesce('the ' || {actor} || ' team', {product}, {heading}, '')", f"({actor} IS NOT NULL OR {product} IS NOT NULL)"


def undefined_acronyms(c: str, ctx: Context) -> str:
    """Acronyms without an expansion in the text."""
    known = {k: v for k, v in ctx.acronyms.items() if v}
    skip = EVERYDAY_ACRONYMS + NOT_ACRONYMS_IN_TEXT + [k for k, v in ctx.acronyms.items() if not v]
    of = f"coalesce(try_element_at(map_from_arrays({T.array_of(list(known))}, {T.array_of(list(known.values()))}), m.match), '')" if known else "''"
    rows = T.matches(c, _CAPITAL_FIRST + r"(?U)\b[A-Z]{2,5}\b", first_of=f"NOT array_contains({T.array_of(skip)}, d)")
    # an acronym is expanded where capitals that end with it stand before a bracket
    said = f"regexp_extract_all({c}, {T.quote(_EXPANDED)}, 1)"
    rows = T.bound(said, "e", f"filter({rows}, m -> NOT exists(e, d -> endswith(d, m.match)))")
    return (f"transform({rows}, m -> {_struct('acronym', 'm.match', T.evidence('m'), f'IF({of} <> {T.quote(str())}, concat(m.match, {T.quote(" (")}, {of}, {T.quote(")")}), {T.quote(str())})', f'{of} <> {T.quote(str())}')})")


def vague_entities(c: str, ctx: Context) -> str:
    thing = ctx.company_name or (ctx.products[0] if len(ctx.products) == 1 else "")
    group = f"the {ctx.actors[0]} team" if len(ctx.actors) == 1 else ""
    by = f"IF(lower(m.match) rlike 'team|group|department', {T.quote(group)}, {T.quote(thing)})"
    return f"transform({T.first_of_each(T.matches(c, _T_FIRST + VAGUE), 'lower(x.match)')}, m -> {_struct('vague_entity', 'm.match', T.evidence('m'), by, by + ' <> ' + T.quote(''))})"


_CLAUSE = r"(?i)^As " + T.any_of("shown", "noted", "mentioned", "discussed", "described") + r" (?:in " + T.any_of("the", "Table", "Section", "Figure") + r"?\s*\w*\s*,?\s*)"
_TAIL = r"(?i)[,;]\s*" + T.any_of("see (?:previous|above).*", r"refer(?:red)? to (?:our |the )?" + T.any_of("previous", "earlier", "above") + ".*") + "$"


def rewritten(sentence: str, reference: str) -> str:
    """A sentence without its dangling reference."""
    without = T.replace(sentence, _CLAUSE, "")
    return f"IF({sentence} rlike {T.quote(_CLAUSE)}, {T.first_upper(without)}, IF(lower({reference}) = lower(rtrim('.', trim({sentence}))), '(remove)', {T.replace(sentence, _TAIL, '.')}))"


def references(c: str) -> str:
    new = rewritten("s", "m.match")
    body = f"transform(array({T.evidence('m')}), s -> transform(array({new}), n -> {_struct('reference', 's', 's', 'IF(n <> s AND n <> ' + T.quote('(remove)') + ', n, ' + T.quote('') + ')', 'n <> s AND n <> ' + T.quote('(remove)'))})[0])[0]"
    return f"transform({T.matches(c, _REFERENCE_FIRST + REFERENCE)}, m -> {body})"


def gaps(c: str, pattern: str) -> str:
    """The first gap in a numbering: an empty array or one of (from, to)."""
    n = f"transform(regexp_extract_all({c}, {T.quote(pattern)}, 1), x -> try_cast(x AS bigint))"
    return f"slice(transform(array({n}), n -> filter(zip_with(slice(n, 1, greatest(size(n) - 1, 0)), slice(n, 2, greatest(size(n) - 1, 0)), (a, b) -> struct(a AS a, b AS b)), z -> z.b <> z.a + 1))[0], 1, 1)"


def sequence_gaps(c: str) -> str:
    return f"transform(concat({gaps(c, _NUMBERED)}, {gaps(c, _STEP)}), z -> {_struct('sequence', 'concat(z.a, ' + T.quote(' to ') + ', z.b)', 'concat(' + T.quote('Steps go ') + ', z.a, ' + T.quote(' to ') + ', z.b)')})"


def complex_sentence(c: str, most: int = MOST_WORDS) -> str:
    """The first sentence of more than ``most`` words."""
    return f"transform(slice(filter({T.sentences(c, False)}, s -> length(s) > {2 * most} AND {T.word_count('s')} > {most}), 1, 1), s -> {_struct('sentence', 's', 's')})"


def with_findings(chunks: DataFrame, ctx: Context | None = None, *, content_col: str = "content", heading_col: str = "heading", into: str = "clarity") -> DataFrame:
    """``chunks`` with an array of findings: issue, term, evidence, proposal, confident."""
    ctx = ctx or Context()
    each = [pronouns(content_col, heading_col, ctx), undefined_acronyms(content_col, ctx), vague_entities(content_col, ctx), references(content_col), sequence_gaps(content_col), complex_sentence(content_col)]
    return chunks.withColumn(into, F.expr(f"CAST(concat({', '.join(each)}) AS array<{_FINDING}>)"))


def findings(chunks: DataFrame, ctx: Context | None = None, *, id_cols: tuple[str, ...] = ("doc_id",), content_col: str = "content", heading_col: str = "heading") -> DataFrame:
    rows = with_findings(chunks.select(*id_cols, content_col, heading_col), ctx, content_col=content_col, heading_col=heading_col)
    fields = ", ".join(f"f.{c} AS {c}" for c in ("issue", "term", "evidence", "proposal", "confident"))
    return structs(rows, id_cols, f"transform(clarity, (f, i) -> struct(i AS ord, {fields}))", "ord")


def _once(c: str, pattern: str, by: str, group: int = 0) -> str:
    """The first match of a pattern replaced by a text (never read as a pattern); ``group`` is what of the match goes."""
    found = f"regexp_extract({c}, {pattern}, {group})"
    at = f"regexp_instr({c}, {pattern})"
    start = at if group == 0 else f"({at} + locate({found}, substr({c}, {at})) - 1)"
    return f"IF({c} rlike {pattern}, overlay({c} PLACING {by} FROM {start} FOR length({found})), {c})"


_ASK = T.any_of("reach out to", "notify", "escalate to", "contact")
_DO = T.any_of("will", "review", "process", "manage", "handle", "can", "also")


def fix(chunks: DataFrame, ctx: Context, *, content_col: str = "content", heading_col: str = "heading", found: str = "clarity") -> DataFrame:
    """Content with sure findings repaired: acronyms expanded at their first place, pronouns and vague words replaced, references rewritten.

    New columns: ``words`` and ``clarity_fixed``, whether something was repaired.
    """
    out = chunks.withColumn("_c", F.col(content_col))
    pick = lambda issue: f"filter({found}, f -> f.issue = '{issue}' AND f.confident AND f.proposal <> '')"
    fold = lambda issue, step: F.expr(f"aggregate({pick(issue)}, _c, (acc, f) -> {step})")
    out = out.withColumn("_c", fold("acronym", _once("acc", "concat('\\\\b', f.term, '\\\\b')", "f.proposal")))
    who, sure = subject(heading_col, ctx)
    team = f"the {ctx.company_name} support team" if ctx.domain_type == "support" else f"the {ctx.company_name} team"
    named = f"coalesce('the ' || get(filter({T.array_of(ctx.actors)}, a -> contains(lower({heading_col}), a)), 0) || ' team', {T.quote(team if ctx.company_name else '')})" if ctx.actors else T.quote(team if ctx.company_name else "")
    out = out.withColumn("_who", F.expr(named))
    ask = T.quote(rf"(?=[RrNnEeCc])(?i)\b{_ASK}\s+(them)\b")
    begin = T.quote(r"(?=T)(?m)(?:^|(?<=[.!?]\s))(They)\s")
    mid = T.quote(rf"(?=[Tt])(?i)\b(they)\s+{_DO}\b")
    for pattern, by in ((ask, "_who"), (begin, f"IF(_c rlike '^They', {T.first_upper('_who')}, _who)"), (mid, "_who")):
        out = out.withColumn("_c", F.expr(f"IF(_who = '', _c, {_once('_c', pattern, by, 1)})"))
    out = out.withColumn("_c", fold("vague_entity", "IF(locate(lower(f.term), lower(acc)) > 0, overlay(acc PLACING f.proposal FROM locate(lower(f.term), lower(acc)) FOR length(f.term)), acc)"))
    out = out.withColumn("_c", fold("reference", "IF(locate(f.term, acc) > 0, overlay(acc PLACING f.proposal FROM locate(f.term, acc) FOR length(f.term)), acc)"))
    out = out.withColumn("clarity_fixed", F.expr(f"coalesce(_c <> {content_col}, false)"))
    tidy = T.replace("trim(" + T.replace("_c", T.SPACE + "{2,}", " ") + ")", r"\.\s*\.", ".")
    return out.withColumn(content_col, F.expr(f"IF(clarity_fixed, {tidy}, {content_col})")).withColumn("words", F.expr(T.word_count(content_col))).drop("_c", "_who")
