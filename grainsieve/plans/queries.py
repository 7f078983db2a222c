"""Registered queries over the driver's tables, each with the DuckDB SQL of the same rows where SQL can say it.

All of them run over whole tables and whole texts; the search ``eval_cosine`` asks for every row whose id is divisible
by 50, of all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.rows import elements, structs
from grainsieve.functions.vocabulary import COMMON, COMMON_CONTENT, COMMON_CORPUS, COMMON_HEADING, DOMAINS, EVERYDAY_ACRONYMS, EXPANSIONS, GENERIC_CONTEXT, MONTHS, NOT_ACRONYMS, NOT_ACRONYMS_IN_TEXT, NOT_ACTORS, TITLE_WORDS
from grainsieve.operators import chunking, clarity, consistency, domain, evaluation, governance, structure, tables, temporal
from grainsieve.plans import duck as D
from grainsieve.plans.corpus import kb, kb_html
from grainsieve.plans.engine import kept

TODAY = "2026-01-01"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _detector_sql(d: governance.Detector) -> str:
    where = d.where.replace("m.match", "m").replace("m.before", "before").replace("m.after", "after")
    said = "m" if d.name == "pii_email" else D.evidence() if d.sentence else "left(m, 100)"
    return f"SELECT doc_id, '{d.name}' AS detector, '{d.tag}' AS tag, ord, {said} AS evidence, m FROM {D.matches('kb', 'doc_id', 'content', d.pattern)} WHERE {where}"


_PLAIN_DETECTORS = [d for d in governance.detectors() if d.where == "true" and not d.once]
_FINDINGS = " UNION ALL ".join(_detector_sql(d) for d in _PLAIN_DETECTORS)


@query(f"{D.WITH_KB} SELECT doc_id, detector, tag, evidence, m AS matched FROM ({_FINDINGS})")
def gov_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the detectors without conditions on their surroundings."""
    return governance.findings(kb(spark, sf_dir), _PLAIN_DETECTORS).select("doc_id", "detector", "tag", "evidence", "matched")


_MAIL = next(d for d in governance.detectors() if d.name == "pii_email")


@query(f"""{D.WITH_KB} SELECT doc_id, m AS evidence FROM {D.matches('kb', 'doc_id', 'content', _MAIL.pattern)}
WHERE lower(split_part(m, '@', 1)) NOT IN ({', '.join(D.q(x) for x in governance.FUNCTIONAL_MAILBOXES)})""")
def gov_pii_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal e-mail addresses."""
    return governance.findings(kb(spark, sf_dir), [_MAIL]).select("doc_id", "evidence")


_PHONES = [d for d in governance.detectors() if d.pattern == governance._PHONE]
_AROUND = "(right(lower(before), 80) || lower(m) || left(lower(after), 30))"


@query(f"""{D.WITH_KB}, ph AS (SELECT doc_id, ord, m, {D.evidence()} AS evidence, {_AROUND} AS near FROM {D.matches('kb', 'doc_id', 'content', governance._PHONE)})
SELECT doc_id, CASE WHEN regexp_matches(near, 'account|routing|bank|swift|iban|reference|invoice|transaction') THEN 'pii_financial' ELSE 'pii_phone' END AS detector, evidence FROM ph
WHERE NOT regexp_matches(near, 'support|helpdesk|call us|reach us|contact us')
  AND (regexp_matches(near, 'account|routing|bank|swift|iban|reference|invoice|transaction') OR NOT regexp_matches(near, 'case|ticket|jira|issue'))""")
def gov_pii_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers and account numbers that look like them, told apart by what stands around."""
    return governance.findings(kb(spark, sf_dir), _PHONES).select("doc_id", "detector", "evidence")


_ONCE = [d for d in governance.detectors() if d.once]


@query(f"""{D.WITH_KB}, f AS ({" UNION ALL ".join(_detector_sql(d) for d in _ONCE)})
SELECT doc_id, detector, evidence FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, detector, lower(left(evidence, 80)) ORDER BY ord) = 1""")
def gov_once_a_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders and vague claims, once a sentence."""
    return governance.findings(kb(spark, sf_dir), _ONCE).select("doc_id", "detector", "evidence")


_ESCALATION = next(d for d in governance.detectors() if d.name == "escalation_no_details")
_BROKEN = next(d for d in governance.detectors() if d.name == "broken_reference")


@query(f"""{D.WITH_KB} SELECT doc_id, 'escalation_no_details' AS detector, {D.evidence()} AS evidence FROM {D.matches('kb', 'doc_id', 'content', _ESCALATION.pattern)}
WHERE NOT (regexp_matches(m, '(?i)^contact') AND regexp_matches(after, '^ (?:via|by|at)')) AND NOT regexp_matches(left(after, 100), '(?i)@|#[a-z0-9_]|slack|phone|ext[.]|email')
UNION ALL SELECT doc_id, 'broken_reference', {D.evidence()} FROM {D.matches('kb', 'doc_id', 'content', _BROKEN.pattern)} WHERE NOT regexp_matches(m, '(?i)^refer to (?:Table|Figure)')""")
def gov_escalation_and_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalations without contact details, references that lead nowhere."""
    return governance.findings(kb(spark, sf_dir), [_ESCALATION, _BROKEN]).select("doc_id", "detector", "evidence")


def _once_sql(f: str) -> str:
    return f"SELECT * FROM ({f}) QUALIFY row_number() OVER (PARTITION BY doc_id, detector, lower(left(evidence, 80)) ORDER BY ord) = 1"


def _told(detector: str, tag: str, pattern: str, where: str, said: str | None = None) -> str:
    return f"SELECT doc_id, '{detector}' AS detector, '{tag}' AS tag, ord, {said or D.evidence()} AS evidence, m FROM {D.matches('kb', 'doc_id', 'content', pattern)} WHERE {where}"


_NEAR_BANK, _NEAR_TICKET, _NEAR_PUBLIC = (f"regexp_matches({_AROUND}, '{x}')" for x in ("account|routing|bank|swift|iban|reference|invoice|transaction", "case|ticket|jira|issue", "support|helpdesk|call us|reach us|contact us"))
_PERSON = next(d for d in governance.detectors() if d.name == "pii_name")
_NO_PERSON = D.items("account appropriate billing card finance issuer management manager on our relevant sales support team the their your".split())
#: What every detector finds: doc_id, detector, tag, ord, evidence, m, and the detector's place.
_ALL_FOUND = " UNION ALL ".join([
    _FINDINGS, _once_sql(" UNION ALL ".join(_detector_sql(d) for d in _ONCE)),
    _told("pii_email", "pii", _MAIL.pattern, f"lower(split_part(m, '@', 1)) NOT IN ({', '.join(D.q(x) for x in governance.FUNCTIONAL_MAILBOXES)})", "m"),
    _told("pii_phone", "pii", governance._PHONE, f"NOT {_NEAR_PUBLIC} AND NOT {_NEAR_BANK} AND NOT {_NEAR_TICKET}"), _told("pii_financial", "pii", governance._PHONE, f"NOT {_NEAR_PUBLIC} AND {_NEAR_BANK}"),
    _told("pii_name", "pii", _PERSON.pattern, f"NOT list_has_any(string_split(lower(regexp_extract(m, '{governance._NAME}$')), ' '), {_NO_PERSON})"),
    _told("escalation_no_details", "escalation", _ESCALATION.pattern, "NOT (regexp_matches(m, '(?i)^contact') AND regexp_matches(after, '^ (?:via|by|at)')) AND NOT regexp_matches(left(after, 100), '(?i)@|#[a-z0-9_]|slack|phone|ext[.]|email')"),
    _told("broken_reference", "broken_reference", _BROKEN.pattern, "NOT regexp_matches(m, '(?i)^refer to (?:Table|Figure)')"),
])


@query(f"{D.WITH_KB} SELECT detector, tag, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM ({_ALL_FOUND}) GROUP BY detector, tag")
def gov_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and documents of every detector."""
    return governance.counts(governance.findings(kb(spark, sf_dir)))


_PLACES = "CASE detector " + " ".join(f"WHEN '{d.name}' THEN {k}" for k, d in reversed([(k, d) for k, d in enumerate(governance.detectors())])) + " END"
_PRIORITY = "CASE tag " + " ".join(f"WHEN '{t}' THEN {p}" for t, _, p, _ in governance.TAGS) + " ELSE 99 END"
_CUT_SENTENCES = f"""array_to_string(list_filter({D.sentences('content')}, lambda s: len(list_filter(k, lambda e: e <> '' AND (contains(lower(s), e) OR contains(e, left(lower(s), 50))))) = 0), ' ')"""
_CUT_INLINE = "c0"
for _names, _pattern in governance.INLINE:
    _CUT_INLINE = f"CASE WHEN list_has_any(named, {D.items(_names.split())}) THEN {D.sub(_CUT_INLINE, _pattern, '')} ELSE {_CUT_INLINE} END"


@query(f"""{D.WITH_KB}, f AS (SELECT *, {_PRIORITY} AS prio, {_PLACES} AS place FROM ({_ALL_FOUND})),
b AS (SELECT doc_id, list_distinct(flatten(list([lower(left(evidence, 50)), lower(left(m, 60))]))) AS k, list(detector) AS named, bool_or(tag = 'internal_only' AND regexp_matches(upper(evidence), 'NOT FOR PUBLICATION|INTERNAL NOTE|FOR INTERNAL USE ONLY|DO NOT SHARE|CONFIDENTIAL')) AS wiped
      FROM f WHERE prio <= {governance.BLOCK_PRIORITY} GROUP BY doc_id),
r AS (SELECT doc_id, arg_min(tag, prio::BIGINT * 1000000000000 + place::BIGINT * 1000000000 + ord) AS tag FROM f WHERE prio > {governance.BLOCK_PRIORITY} AND doc_id NOT IN (SELECT doc_id FROM b) GROUP BY doc_id),
c AS (SELECT doc_id, content, named, wiped, k IS NOT NULL AS blocked, CASE WHEN k IS NOT NULL THEN {_CUT_SENTENCES} END AS c0 FROM kb LEFT JOIN b USING (doc_id)),
d AS (SELECT doc_id, content, blocked, CASE WHEN NOT blocked THEN content WHEN wiped THEN '' ELSE {_CUT_INLINE} END AS new FROM c),
e AS (SELECT doc_id, content, blocked, CASE WHEN blocked THEN {D.sub('trim(' + D.sub('new', T.SPACE + '{2,}', ' ') + ')', chr(92) + '.' + chr(92) + 's*' + chr(92) + '.', '.')} ELSE new END AS new FROM d),
g AS (SELECT doc_id, content, new, blocked AND {D.squeeze('new')} <> {D.squeeze('content')} AS changed FROM e),
h AS (SELECT doc_id, changed, {D.word_count('content')}::INTEGER AS words_before, CASE WHEN NOT changed THEN content WHEN {D.word_count('new')} < {governance.LEAST_WORDS} THEN '' ELSE new END AS content FROM g)
SELECT doc_id, content, CASE WHEN changed THEN 'content' ELSE coalesce(r.tag, 'content') END AS tag, changed, words_before, {D.word_count('content')}::INTEGER AS words FROM h LEFT JOIN r USING (doc_id)""")
def gov_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after governance: words before and after, tag, whether it changed."""
    return governance.clean(governance.with_findings(kb(spark, sf_dir))).select("doc_id", "content", "tag", "changed", "words_before", "words")


_RULES = [{"pattern": "refund requests", "action": "review", "reason": "policy"}, {"pattern": "billing|legal", "action": "block", "reason": "legal"}]


@query(f"""{D.WITH_KB}, c AS (SELECT doc_id, CASE WHEN regexp_matches(content, '(?i)refund requests') THEN 'custom_review' WHEN regexp_matches(content, '(?i)billing|legal') THEN 'custom_block' ELSE 'content' END AS tag FROM kb)
SELECT doc_id, tag, CASE tag WHEN 'content' THEN 'answer' WHEN 'custom_block' THEN 'allow' ELSE 'review' END AS behavior FROM c""")
def gov_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom rules, the first that matches, and tag behaviour with an override."""
    c = governance.custom_rules(kb(spark, sf_dir).withColumn("tag", F.lit("content")), _RULES)
    return governance.behavior(c, {"custom_block": "allow"}).select("doc_id", "tag", "behavior")


_BLOCKS = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, {D.q('(?i)<' + chunking._BLOCK + '[' + chr(92) + 's>]')}, chr(3) || {D.q(chr(92) + '0')}, 'g'), {D.q('(?i)</' + chunking._BLOCK + '>')}, {D.q(chr(92) + '0')} || chr(3), 'g'), {D.q(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}, chr(3), 'g'), chr(3)), lambda b: {D.plain('b')}), lambda b: len({D.parts('b', T.SPACE + '+').replace('lambda x', 'lambda y').replace('x <>', 'y <>')}) > 3)"


@query(f"{D.WITH_HTML} SELECT doc_id, CAST(unnest(range(len(b))) AS INTEGER) AS block_no, unnest(b) AS block FROM (SELECT doc_id, {_BLOCKS} AS b FROM page)")
def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and elements of every document."""
    return elements(chunking.with_blocks(kb_html(spark, sf_dir), "html"), ("doc_id",), "blocks", "block", "block_no")


_W = lambda c: D.word_count(c)
_MOST, _LEAST = chunking.MAX_WORDS, chunking.MIN_WORDS
_LAST_END = f"list_filter(range(1, {_MOST}), lambda j: regexp_matches(rest[j], '[.!?]$') AND regexp_matches(rest[j + 1], '^[A-Z]'))[-1]"


@query(f"""WITH RECURSIVE {D.WITH_HTML.removeprefix('WITH ')}, bl AS (SELECT doc_id, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS x FROM (SELECT doc_id, {_BLOCKS} AS b FROM page)), bn AS (SELECT *, {_W('x')} AS n FROM bl),
fl(doc_id, i, g, size) AS (SELECT doc_id, i, 1::BIGINT, n FROM bn WHERE i = 1 UNION ALL SELECT bn.doc_id, bn.i, CASE WHEN size > 0 AND size + n > {_MOST} THEN g + 1 ELSE g END, CASE WHEN size > 0 AND size + n > {_MOST} THEN n ELSE size + n END FROM fl JOIN bn ON bn.doc_id = fl.doc_id AND bn.i = fl.i + 1),
fd AS (SELECT doc_id, g, trim(string_agg(x, ' ' ORDER BY i)) AS x FROM fl JOIN bn USING (doc_id, i) GROUP BY ALL),
cut(doc_id, g, k, piece, rest) AS (SELECT doc_id, g, 0::BIGINT, NULL::VARCHAR, {D.parts('x', T.SPACE + '+')} FROM fd
  UNION ALL SELECT doc_id, g, k + 1, array_to_string(rest[1:n], ' '), rest[n + 1:] FROM (SELECT *, CASE WHEN len(rest) <= {_MOST} THEN len(rest) WHEN coalesce(length(array_to_string(rest[1:j], ' ')) > 0.3 * length(array_to_string(rest[1:{_MOST}], ' ')), false) THEN j ELSE {_MOST} END AS n
    FROM (SELECT *, CASE WHEN len(rest) > {_MOST} THEN {_LAST_END} END AS j FROM cut WHERE len(rest) > 0))),
pc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, k) AS i, piece AS x, {_W('piece')} AS n FROM cut WHERE k > 0),
mg(doc_id, i, m, size) AS (SELECT doc_id, i, 1::BIGINT, n FROM pc WHERE i = 1 UNION ALL SELECT pc.doc_id, pc.i, CASE WHEN size < {_LEAST} AND size + n <= 1.2 * {_MOST} THEN m ELSE m + 1 END, CASE WHEN size < {_LEAST} AND size + n <= 1.2 * {_MOST} THEN size + n ELSE n END FROM mg JOIN pc ON pc.doc_id = mg.doc_id AND pc.i = mg.i + 1),
ck AS (SELECT doc_id, m, string_agg(x, ' ' ORDER BY i) AS content FROM mg JOIN pc USING (doc_id, i) GROUP BY ALL)
SELECT doc_id, m::INTEGER AS chunk_no, '' AS heading, content, {_W('content')}::INTEGER AS words FROM ck WHERE {_W('content')} >= 3""")
def chunk_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive chunks."""
    return chunking.raw_chunks(kb_html(spark, sf_dir), text_col="html")


@query()
def chunk_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by section and topic."""
    return chunking.smart_chunks(kb_html(spark, sf_dir).select("doc_id", F.expr(structure.sections("html")).alias("sections")))


_SENTENCES = f"list_filter(list_transform({D.sentences('content', True)}, lambda s: trim(s)), lambda s: length(s) > 5)"


@query(f"""{D.WITH_KB}, s AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS s, len(a) AS n FROM (SELECT doc_id, {_SENTENCES} AS a FROM kb)),
w AS (SELECT DISTINCT doc_id, i, unnest(list_filter({D.words('s', 4)}, lambda x: NOT list_contains({D.items(COMMON)}, x))) AS w FROM s),
cut AS (SELECT doc_id, i FROM s WHERE i > 1 AND n >= 3),
x AS (SELECT DISTINCT c.doc_id, c.i, w.w FROM cut c JOIN w ON c.doc_id = w.doc_id AND w.i BETWEEN c.i - 2 AND c.i - 1),
y AS (SELECT DISTINCT c.doc_id, c.i, w.w FROM cut c JOIN w ON c.doc_id = w.doc_id AND w.i BETWEEN c.i AND c.i + 1),
nx AS (SELECT doc_id, i, count(*) AS n FROM x GROUP BY ALL), ny AS (SELECT doc_id, i, count(*) AS n FROM y GROUP BY ALL), nb AS (SELECT doc_id, i, count(*) AS n FROM x JOIN y USING (doc_id, i, w) GROUP BY ALL),
j AS (SELECT doc_id, i, coalesce(nb.n / (nx.n + ny.n - nb.n), 0) AS j FROM cut LEFT JOIN nx USING (doc_id, i) LEFT JOIN ny USING (doc_id, i) LEFT JOIN nb USING (doc_id, i))
SELECT doc_id, count(*) FILTER (WHERE j < 0.1) AS shifts, coalesce(sum(i - 1) FILTER (WHERE j < 0.1), 0)::BIGINT AS places FROM j GROUP BY doc_id""")
def chunk_topic_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many topic shifts each document has, and the sum of their places."""
    s = kb(spark, sf_dir).select("doc_id", F.expr(chunking.sentence_list("content")).alias("s")).where("size(s) >= 3")
    b = s.select("doc_id", F.expr(chunking.boundaries("s")).alias("b"))
    return b.select("doc_id", F.size("b").cast("long").alias("shifts"), F.expr("aggregate(b, 0L, (a, x) -> a + x)").alias("places"))


@query(f"{D.WITH_KB}, w AS (SELECT unnest({D.words('content', 4)}) AS word FROM kb) SELECT word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(map(D.q, COMMON_CORPUS))}) GROUP BY word")
def domain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word frequencies of the corpus."""
    return domain.word_frequencies(kb(spark, sf_dir))


_SIGNALS = ", ".join(f"('{d}', {i}, '{w}')" for i, (d, ws) in enumerate(DOMAINS) for w in ws.split())


@query(f"""{D.WITH_KB}, w AS (SELECT unnest({D.words('content', 4)}) AS word FROM kb), f AS (SELECT word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(map(D.q, COMMON_CORPUS))}) GROUP BY word),
g(domain, ord, word) AS (VALUES {_SIGNALS}), s AS (SELECT domain, ord, coalesce(sum(n), 0) AS score FROM g LEFT JOIN f USING (word) GROUP BY ALL)
SELECT CASE WHEN sum(score) > 0 THEN arg_max(domain, score * 100 - ord) ELSE 'general' END AS domain_type, CASE WHEN sum(score) > 0 THEN round(max(score)::DOUBLE / sum(score)::DOUBLE, 2) ELSE 0 END AS confidence FROM s""")
def domain_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What domain the corpus belongs to."""
    return domain.domain_type(domain.domain_scores(domain.word_frequencies(kb(spark, sf_dir))))


def _each(patterns: list[tuple[str, int]]) -> str:
    """Groups of all matches, with patterns in RE2's words."""
    return " UNION ALL ".join(f"SELECT doc_id, {k} AS which, unnest(regexp_extract_all(content, {D.q(p.replace('(?iU)', '(?i)').replace('(?U)', ''))}, {g})) AS found FROM kb" for k, (p, g) in enumerate(patterns))


@query(f"""{D.WITH_KB}, f AS (SELECT lower(found) AS actor FROM ({_each(domain.ACTOR_PATTERNS)}))
SELECT actor, count(*) AS n FROM f WHERE length(actor) > 2 AND actor NOT IN ({', '.join(map(D.q, NOT_ACTORS))}) GROUP BY actor HAVING count(*) >= 2""")
def domain_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who does something."""
    return domain.actors(kb(spark, sf_dir)).select("actor", "n")


_ACRONYMS = f"""{D.WITH_KB}, t AS (SELECT unnest(list_filter(string_split_regex(regexp_replace(content, '([A-Z]{{2,5}})-([0-9])', 'x', 'g'), {D.q(T.NOT_WORD)}), lambda x: regexp_full_match(x, '[A-Z]{{2,5}}'))) AS acronym FROM kb),
n AS (SELECT acronym, count(*) AS n FROM t WHERE acronym NOT IN ({', '.join(map(D.q, EVERYDAY_ACRONYMS + NOT_ACRONYMS))}) GROUP BY acronym)
"""


@query(f"{_ACRONYMS} SELECT acronym, n FROM n")
def domain_acronym_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often acronyms are used."""
    found = domain._found(kb(spark, sf_dir), [(r"(?U)\b([A-Z]{2,5})\b(?!-\d)", 1)], "content", ("doc_id",))
    return found.where(~F.col("found").isin(EVERYDAY_ACRONYMS + NOT_ACRONYMS)).groupBy(F.col("found").alias("acronym")).agg(F.count("*").alias("n"))


_NAME_FIRST, _ACRONYM_FIRST = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*\(([A-Z]{2,6})\)", r"([A-Z]{2,6})\s*\(([A-Z][a-z]+(?:\s+[a-zA-Z]+)*)\)"
_SAID = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS which, unnest(range(len(a))) AS pos, unnest(a) AS acronym, unnest(e) AS expansion FROM (SELECT doc_id, regexp_extract_all(content, {D.q(p)}, {a}) AS a, regexp_extract_all(content, {D.q(p)}, {e}) AS e FROM kb)"
    for k, (p, a, e) in enumerate(((_NAME_FIRST, 2, 1), (_ACRONYM_FIRST, 1, 2))))
_KNOWN = ", ".join(f"({D.q(k)}, {D.q(v)})" for k, v in EXPANSIONS.items())


@query(f"""{_ACRONYMS}, said AS ({_SAID}), told AS (SELECT acronym, arg_max(expansion, doc_id * 10000000000 + which::BIGINT * 1000000000 + pos) AS told FROM said GROUP BY acronym), known(acronym, usual) AS (VALUES {_KNOWN})
SELECT acronym, n, coalesce(told, usual) AS expansion FROM n LEFT JOIN told USING (acronym) LEFT JOIN known USING (acronym) WHERE coalesce(told, usual) IS NOT NULL OR n >= 3""")
def domain_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms and what they stand for."""
    return domain.acronyms(kb(spark, sf_dir))


@query(f"""{D.WITH_KB}, f AS ({_each(domain.PRODUCT_PATTERNS)}) SELECT DISTINCT CASE WHEN which < 2 THEN upper(found[1]) || lower(found[2:]) ELSE found END AS product FROM f
WHERE (which < 2 OR (found NOT IN ({', '.join(map(D.q, TITLE_WORDS))}) AND found <> 'Acme')) AND lower(found) <> 'free'""")
def domain_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans and products."""
    return domain.products(kb(spark, sf_dir), "Acme")


@query(f"""{D.WITH_KB}, f AS ({_each([(p, int(k == 'version')) for k, p in domain.SCOPE_PATTERNS.items()])})
SELECT DISTINCT CASE which WHEN 0 THEN 'region' WHEN 1 THEN 'tier' ELSE 'version' END AS type, CASE WHEN which = 2 THEN 'v' || found WHEN lower(found) = 'north america' THEN 'North America' ELSE upper(found[1]) || lower(found[2:]) END AS value FROM f""")
def domain_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, tiers and versions."""
    return domain.scopes(kb(spark, sf_dir))


_DESTROY = " UNION ALL ".join(f"SELECT unnest(list_transform(list_zip(regexp_extract_all(content, {D.q(p.replace('(?iU)', '(?i)'))}, {a}), regexp_extract_all(content, {D.q(p.replace('(?iU)', '(?i)'))}, {b})), lambda x: lower(x[1] || ' ' || x[2]))) AS phrase FROM kb" for p, a, b in domain.DESTRUCTIVE_PATTERNS)


@query(f"{D.WITH_KB} SELECT DISTINCT phrase FROM ({_DESTROY})")
def domain_destructive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions that destroy something."""
    return domain.destructive_phrases(kb(spark, sf_dir)).select("phrase")


@query(f"""{D.WITH_KB}, w AS (SELECT unnest({D.words('content', 4)}) AS word FROM kb), f AS (SELECT word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(map(D.q, COMMON_CORPUS))}) GROUP BY word HAVING count(*) >= 2)
SELECT left(word, 6) AS stem, first(word ORDER BY n DESC, word) AS anchor, string_agg(word, '|' ORDER BY word) AS words FROM f WHERE length(word) >= 6 GROUP BY 1""")
def domain_topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one stem and the most frequent of them."""
    return domain.topic_groups(domain.word_frequencies(kb(spark, sf_dir))).select("stem", "anchor", F.array_join("words", "|").alias("words"))


_PARTS = f"string_split(regexp_replace(html, '(?is)<h[1-6](?:{chr(92)}s[^>]*)?>.*?</h[1-6]>', chr(3) || '{chr(92)}0', 'g'), chr(3))"
_TITLE = f"'(?is)^<h([1-6])(?:{chr(92)}s[^>]*)?>(.*?)</h[1-6]>'"
_BARE_TITLE = f"trim({D.sub('trim(heading)', ':+' + chr(92) + 's*$', '')})"
_UPPER = lambda c: f"(upper(left({c}, 1)) || substr({c}, 2))"
_EARLY = f"array_to_string(list_filter({D.parts('clean', T.SPACE + '+')}[1:15], lambda w: length(w) > 2 AND NOT list_contains({D.items(structure.STOP_HEADING)}, {D.sub('lower(w)', '[.,;:]+$', '')}))[1:4], ' ')"


@query(f"""{D.WITH_HTML}, p AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS p FROM (SELECT doc_id, {_PARTS} AS a FROM page)),
s AS (SELECT doc_id, i, trim({D.sub(f"regexp_extract(p, {_TITLE}, 2)", '<[^>]+>', '')}) AS heading, coalesce(TRY_CAST(regexp_extract(p, {_TITLE}, 1) AS INTEGER), 0) AS level, {D.cell("trim(regexp_replace(p, '(?is)^<h[1-6](?:" + chr(92) + "s[^>]*)?>.*?</h[1-6]>', ''))")} AS cleaned FROM p),
n AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS section_no, heading, level, cleaned, CAST({D.word_count('cleaned')} AS INTEGER) AS words, level = 0 AND heading = '' AS is_orphan FROM s WHERE {D.word_count('cleaned')} > 0),
g AS (SELECT *, NOT is_orphan AND words >= {structure.LEAST_WORDS} AND (bare = '' OR regexp_matches(bare, {D.q(structure.GENERIC)}) OR ({D.word_count('bare')} = 1 AND length(bare) < 5)) AS is_generic FROM (SELECT *, {_BARE_TITLE} AS bare FROM n)),
f AS (SELECT *, words >= {structure.LEAST_WORDS} AND (is_orphan OR is_generic) AS fix, CASE WHEN words >= {structure.LEAST_WORDS} AND (is_orphan OR is_generic) THEN cleaned END AS clean FROM g),
h AS (SELECT *, array_to_string({D.sentences('clean')}[1:2], ' ') AS early FROM f),
c AS (SELECT *, trim({D.sub(f"trim(regexp_extract(early, {D.q(structure.SUBJECT)}, 1))", '[.,;:]+$', '')}) AS a, trim({D.sub(f"trim(regexp_extract(early, {D.q(structure.ABOUT)}, 1))", '[.]+$', '')}) AS b FROM h),
w AS (SELECT doc_id, section_no, unnest(range(len(a))) AS place, unnest(a) AS word FROM (SELECT doc_id, section_no, {D.words('clean', 3)} AS a FROM f WHERE fix)),
top AS (SELECT doc_id, section_no, upper(word[1]) || word[2:] AS word, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY n DESC, place) AS k FROM (SELECT doc_id, section_no, word, count(*) AS n, min(place) AS place FROM w WHERE word NOT IN ({', '.join(map(D.q, structure.STOP_HEADING))}) GROUP BY ALL)),
d AS (SELECT doc_id, section_no, string_agg(word, ' ' ORDER BY k) AS d FROM top WHERE k <= 3 GROUP BY ALL),
o AS (SELECT c.*, CASE WHEN fix THEN coalesce(CASE WHEN a <> '' AND {D.word_count('a')} <= 5 THEN {_UPPER('a')} WHEN b <> '' THEN {_UPPER('b')} END, d, nullif({_UPPER(D.sub(_EARLY, '[.,;:]+$', ''))}, '')) END AS new FROM c LEFT JOIN d USING (doc_id, section_no))
SELECT doc_id, section_no, coalesce(new, heading) AS new_heading, CASE WHEN is_generic THEN heading ELSE '' END AS original_heading, CASE WHEN new IS NULL THEN 'original' WHEN is_generic THEN 'replaced' ELSE 'generated_rule' END AS heading_source,
  CASE WHEN new IS NOT NULL AND level = 0 THEN 2 ELSE level END AS new_level, level, heading, words, is_orphan, is_generic FROM o""")
def structure_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their headings, old and new."""
    return structure.named_sections(kb_html(spark, sf_dir)).drop("content")


@query(f"""{D.WITH_HTML}, p AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS p FROM (SELECT doc_id, {_PARTS} AS a FROM page)),
s AS (SELECT doc_id, i, trim(regexp_replace(regexp_extract(p, '(?is)^<h([1-6])(?:{chr(92)}s[^>]*)?>(.*?)</h[1-6]>', 2), '<[^>]+>', '', 'g')) AS heading,
  coalesce(TRY_CAST(regexp_extract(p, '(?is)^<h([1-6])(?:{chr(92)}s[^>]*)?>(.*?)</h[1-6]>', 1) AS INTEGER), 0) AS level,
  regexp_replace(p, '(?is)^<h[1-6](?:{chr(92)}s[^>]*)?>.*?</h[1-6]>', '') AS body FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS section_no, heading, level, CAST({D.word_count(D.cell('body'))} AS INTEGER) AS words FROM s WHERE {D.word_count(D.cell('body'))} > 0""")
def structure_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document is cut into sections."""
    rows = structs(kb_html(spark, sf_dir).select("doc_id", "html"), ("doc_id",), structure.sections("html"), "section_no")
    return rows.select("doc_id", "section_no", "heading", "level", "words")


@query(f"""{D.WITH_HTML}, t AS (SELECT doc_id, ord, m, before FROM {D.matches('page', 'doc_id', 'html', tables.TABLE)}),
c AS (SELECT doc_id, ord, {D.cell(f"regexp_extract_all(before, '(?is)<h[1-6](?:{chr(92)}s[^>]*)?>(.*?)</h[1-6]>', 1)[-1]")} AS heading,
  list_transform(regexp_extract_all(m, '(?is)<th[^>]*>(.*?)</th>', 1), lambda x: trim(x)) AS h, regexp_extract_all(m, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS rows FROM t),
r AS (SELECT doc_id, ord, heading, h, unnest(range(len(rows))) AS i, list_transform(regexp_extract_all(unnest(rows), '(?is)<td[^>]*>(.*?)</td>', 1), lambda x: trim(x)) AS v FROM c)
SELECT doc_id, ord::INTEGER AS table_no, heading, heading || ' — ' || v[1] || ': ' || array_to_string(list_filter(list_transform(range(2, len(v) + 1), lambda k: CASE WHEN lower(v[k]) IN ('', '-', 'n/a', 'none') THEN NULL ELSE h[k] || ': ' || v[k] END), lambda x: x IS NOT NULL), '. ') || '.' AS row_text
FROM r WHERE len(v) > 0""")
def structure_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows as sentences."""
    return elements(tables.tables(kb_html(spark, sf_dir)), ("doc_id", "table_no", "heading"), "row_texts", "row_text")


@query(f"""{D.WITH_HTML}, l AS (SELECT doc_id, ord, list_transform(regexp_extract_all(m, '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: {D.cell('x')}) AS steps FROM {D.matches('page', 'doc_id', 'html', tables.LIST)})
SELECT doc_id, ord::INTEGER AS list_no, array_to_string(list_transform(range(1, len(steps) + 1), lambda i: 'Step ' || i || ': ' || steps[i] || '.'), ' ') AS content FROM l WHERE len(steps) > 0""")
def structure_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lists as steps."""
    return tables.procedures(kb_html(spark, sf_dir)).select("doc_id", "list_no", "content")


_WORDS_OF = lambda c: f"list_filter({D.words(c, 3)}, lambda x: NOT list_contains(['figure', 'available', 'not', 'image'], x))"
_FITS = lambda x: f"({x} <> '' AND (len(w) = 0 OR list_has_any({D.words(x, 3)}, w)))"


_FIGURES = f"""{D.WITH_HTML}, f AS (SELECT doc_id, ord, regexp_extract(m, {D.q(tables._NUMBERED)}, 1) AS figure_no, {D.cell(f"regexp_extract(m, {D.q(tables._NUMBERED)}, 2)")} AS caption,
  coalesce({D.cell(f"regexp_extract_all(before, '(?is)<h[1-6](?:{chr(92)}s[^>]*)?>(.*?)</h[1-6]>', 1)[-1]")}, '') AS heading, {D.cell('left(after, 600)')} AS after FROM {D.matches('page', 'doc_id', 'html', tables.FIGURE)}),
g AS (SELECT *, list_distinct({_WORDS_OF('caption')}) AS w, trim(regexp_extract(after, {D.q(tables.SHOWN)}, 0)) AS a, trim(regexp_extract(after, {D.q(tables.STAGES)}, 0)) AS b FROM f),
h AS (SELECT *, array_to_string(list_transform(list_filter({D.sentences('after')}[1:4], lambda s: list_has_any({D.words('s', 3)}, w)), lambda s: trim(s)), ' ') AS c FROM g),
d AS (SELECT *, CASE WHEN {_FITS('a')} THEN a WHEN {_FITS('b')} THEN b WHEN c <> '' THEN c END AS description, {_FITS('a')} OR {_FITS('b')} AS sure FROM h)"""
_FIGURE_ROWS = f"""SELECT doc_id, CAST(ord AS INTEGER) AS ord, figure_no, caption, heading, CASE WHEN regexp_matches(lower(caption), 'flow|process|pipeline|sequence') THEN 'process' WHEN regexp_matches(lower(caption), 'chart|graph|trend|revenue|volume|metric') THEN 'chart' WHEN regexp_matches(lower(caption), 'diagram|structure|architecture|comparison|tier|overview') THEN 'structure' ELSE 'unknown' END AS type,
  description, CASE WHEN sure THEN 'high' ELSE 'low' END AS confidence, description IS NULL AS is_gap, 'Figure ' || figure_no || ': ' || caption || CASE WHEN description IS NULL THEN ' (no description)' ELSE '' END AS summary,
  coalesce(description, 'No description available for ' || caption || '.') || CASE WHEN contains(lower(caption), 'image not available') THEN ' (Note: original image not available.)' ELSE '' END AS content FROM d"""


@query(f"{_FIGURES} {_FIGURE_ROWS}")
def structure_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and what the text says of them."""
    return tables.figures(kb_html(spark, sf_dir)).drop("original")


_HEADING_BEFORE = "coalesce(" + D.cell(f"regexp_extract_all(before, '(?is)<h[1-6](?:{chr(92)}s[^>]*)?>(.*?)</h[1-6]>', 1)[-1]") + ", '')"
_CELLS = lambda c, tag: f"list_transform(regexp_extract_all({c}, '(?is)<{tag}(?:{chr(92)}s[^>]*)?>(.*?)</{tag}>', 1), lambda x: {D.cell('x')})"
_TOLD = "list_filter(list_transform(range(1, len(r) + 1), lambda k: CASE WHEN lower(r[k]) IN ('', '-', 'n/a', 'none') THEN NULL WHEN coalesce(h[k], '') = '' THEN r[k] ELSE h[k] || ': ' || r[k] END), lambda x: x IS NOT NULL)"
_FEW = "lower(array_to_string(h[1:4], ', '))"


def _put(html: str, pattern: str, news: str) -> str:
    """``html`` with the matches of a pattern replaced by a map from their numbers; those without stay."""
    cut = f"string_split(regexp_replace({html}, {D.q(pattern)}, chr(1) || '{chr(92)}0' || chr(2), 'g'), chr(1))"
    return f"array_to_string(list_transform({cut}, lambda x, i: CASE WHEN i = 1 THEN x ELSE coalesce({news}[i - 1], string_split(x, chr(2))[1]) || string_split(x, chr(2))[2] END), '')"


@query(f"""{_FIGURES}, figure AS ({_FIGURE_ROWS}),
tb AS (SELECT doc_id, ord, {_HEADING_BEFORE} AS heading, {_CELLS('m', 'th')} AS h, regexp_extract_all(m, '(?is)<tr(?:{chr(92)}s[^>]*)?>(.*?)</tr>', 1) AS rs FROM {D.matches('page', 'doc_id', 'html', tables.TABLE)}),
tr AS (SELECT *, {_TOLD} AS p FROM (SELECT doc_id, ord, heading, h, i, {_CELLS('tr', 'td')} AS r FROM (SELECT doc_id, ord, heading, h, unnest(range(len(rs))) AS i, unnest(rs) AS tr FROM tb)) WHERE len(r) > 0),
tx AS (SELECT doc_id, ord, i, CASE WHEN len(h) > 0 THEN CASE WHEN len(p) = 0 THEN NULL WHEN heading <> '' AND r[1] <> '' THEN heading || ' — ' || r[1] || ': ' || array_to_string(p[2:], '. ') || '.' WHEN heading <> '' THEN heading || ': ' || array_to_string(p, '. ') || '.' ELSE array_to_string(p, '. ') || '.' END
    ELSE CASE WHEN heading = '' THEN '' ELSE heading || ': ' END || nullif(array_to_string(list_filter(r, lambda x: x <> ''), ', '), '') || '.' END AS x FROM tr),
tt AS (SELECT tb.doc_id, tb.ord, '<p>' || CASE WHEN len(any_value(h)) = 0 THEN CASE WHEN any_value(heading) = '' THEN 'Table' ELSE any_value(heading) END WHEN any_value(heading) = '' THEN 'Table showing ' || any_value({_FEW}) ELSE any_value(heading) || ': ' || any_value({_FEW}) END || '.</p>'
    || coalesce(string_agg('<p>' || x || '</p>', '' ORDER BY i), '') AS new FROM tb LEFT JOIN tx ON tx.doc_id = tb.doc_id AND tx.ord = tb.ord GROUP BY tb.doc_id, tb.ord HAVING len(any_value(h)) > 0 OR count(i) > 0),
pl AS (SELECT doc_id, ord, {_HEADING_BEFORE} AS heading, {_CELLS('m', 'li')} AS steps, {D.cell('right(before, 300)')} AS b FROM {D.matches('page', 'doc_id', 'html', tables.LIST)}),
pp AS (SELECT doc_id, ord, '<p>' || len(steps) || '-step procedure' || CASE WHEN heading <> '' THEN ' for ' || lower(heading) WHEN b <> '' THEN ': ' || left(b, 80) ELSE '' END || '. ' || array_to_string(list_transform(steps, lambda x, i: 'Step ' || i || ': ' || x || '.'), ' ') || '</p>' AS new FROM pl WHERE len(steps) > 0),
mt AS (SELECT doc_id, map_from_entries(list((ord, new))) AS mt FROM tt GROUP BY doc_id), mf AS (SELECT doc_id, map_from_entries(list((ord::BIGINT, '<p>' || summary || '. ' || content || '</p>'))) AS mf FROM figure GROUP BY doc_id), mp AS (SELECT doc_id, map_from_entries(list((ord, new))) AS mp FROM pp GROUP BY doc_id),
x1 AS (SELECT doc_id, heading, mf, mp, {_put('html', tables.TABLE, 'mt')} AS html FROM page LEFT JOIN mt USING (doc_id) LEFT JOIN mf USING (doc_id) LEFT JOIN mp USING (doc_id)),
x2 AS (SELECT doc_id, heading, mp, {_put('html', tables.FIGURE, 'mf')} AS html FROM x1)
SELECT doc_id, heading, {_put('html', tables.LIST, 'mp')} AS html FROM x2""")
def structure_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tables, figures and lists as paragraphs."""
    return tables.normalized(kb_html(spark, sf_dir))


_MONTH = f"list_position({D.items(list(MONTHS))}, lower(x[2])[1:3])"
_DATES = f"""SELECT doc_id, 'month_year' AS type, x[1] AS raw, CAST(x[3] AS INTEGER) AS year, {_MONTH} AS month FROM (SELECT doc_id, unnest(list_transform(list_zip(regexp_extract_all(content, {D.q(temporal.MONTH_YEAR)}, 0), regexp_extract_all(content, {D.q(temporal.MONTH_YEAR)}, 1), regexp_extract_all(content, {D.q(temporal.MONTH_YEAR)}, 3)), lambda z: [z[1], z[2], z[3]])) AS x FROM kb)
UNION ALL SELECT doc_id, 'quarter', x[1], CAST(x[3] AS INTEGER), 3 * CAST(x[2] AS INTEGER) - 2 FROM (SELECT doc_id, unnest(list_transform(list_zip(regexp_extract_all(content, {D.q(temporal.QUARTER)}, 0), regexp_extract_all(content, {D.q(temporal.QUARTER)}, 1), regexp_extract_all(content, {D.q(temporal.QUARTER)}, 2)), lambda z: [z[1], z[2], z[3]])) AS x FROM kb)
UNION ALL SELECT doc_id, 'iso', x[1], CAST(x[2] AS INTEGER), CAST(x[3] AS INTEGER) FROM (SELECT doc_id, unnest(list_transform(list_zip(regexp_extract_all(content, {D.q(temporal.ISO)}, 0), regexp_extract_all(content, {D.q(temporal.ISO)}, 1), regexp_extract_all(content, {D.q(temporal.ISO)}, 2)), lambda z: [z[1], z[2], z[3]])) AS x FROM kb)"""


@query(f"{D.WITH_KB}, d AS ({_DATES}) SELECT doc_id, type, raw, year, CAST(month AS INTEGER) AS month, CAST(12 * (2026 - year) + 1 - month AS INTEGER) AS age_months FROM d WHERE year BETWEEN 2015 AND 2030 AND month BETWEEN 1 AND 12")
def temporal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that the texts mention, and their age."""
    rows = structs(temporal.enrich(kb(spark, sf_dir), TODAY), ("doc_id",), "dates", "type")
    return rows.select("doc_id", "type", "raw", "year", "month", "age_months")


@query(f"""{D.WITH_KB}, a AS (SELECT doc_id, array_to_string(regexp_extract_all(content, {D.q(temporal.VERSION)}, 1), '|') AS versions,
  TRY_CAST(CASE WHEN contains(last_modified, 'T') THEN split_part(last_modified, 'T', 1) ELSE left(last_modified, 10) END AS DATE) AS d FROM kb)
SELECT doc_id, versions, CAST(12 * (2026 - year(d)) + 1 - month(d) AS INTEGER) AS page_age_months, coalesce(12 * (2026 - year(d)) + 1 - month(d) > 6, false) AS is_stale FROM a""")
def temporal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions, age of the page, whether it's stale."""
    return temporal.enrich(kb(spark, sf_dir), TODAY).select("doc_id", F.array_join("versions", "|").alias("versions"), "page_age_months", "is_stale")


_CTX = domain.Context("support", 1.0, "Acme", ["billing", "finance", "legal", "support"], dict(EXPANSIONS), ["Enterprise", "Pro"], {"region": ["Europe", "Asia"]})


def _first_in(values: list[str]) -> str:
    return f"list_filter({D.items(values)}, lambda a: contains(lower(heading), lower(a)))[1]"


#: Acronyms between marks: there is no word border of all scripts here, so every character that is of no word is doubled by a mark first.
_BORDERED = D.sub(D.sub("content", r"([^\p{L}\p{N}_])", "\\1\x05"), r"(^|\x05)([A-Z]{2,5})([^\p{L}\p{N}_]|$)", "\\1\x06\\2\x07\\3")
_ACRONYM_PLACES = f"""(SELECT doc_id, content, i - 1 AS ord, string_split(p[i], chr(7))[1] AS m, replace(replace(array_to_string(p[1:i-1], ''), chr(7), ''), chr(5), '') AS before,
  replace(replace(string_split(p[i], chr(7))[2] || array_to_string(p[i+1:], ''), chr(7), ''), chr(5), '') AS after
  FROM (SELECT doc_id, content, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT doc_id, content, string_split({_BORDERED}, chr(6)) AS p FROM kb)))"""
_SENTENCE_LIST = f"string_split({D.sub('content', '([.!?])', chr(92) + '1' + chr(1))}, chr(1))"
_BARE_ENDS = r"rtrim(trim(s), '.')"
_REWORDED = f"""CASE WHEN regexp_matches(s, {D.q(clarity._CLAUSE)}) THEN upper(left({D.sub('s', clarity._CLAUSE, '')}, 1)) || substr({D.sub('s', clarity._CLAUSE, '')}, 2)
  WHEN lower(m) = lower({_BARE_ENDS}) THEN '(remove)' ELSE {D.sub('s', clarity._TAIL, '.')} END"""


def _gap_sql(k: int, pattern: str) -> str:
    return f"""SELECT doc_id, 4 AS kind, {k} AS ord, 'sequence' AS issue, n[i] || ' to ' || n[i + 1] AS term, 'Steps go ' || n[i] || ' to ' || n[i + 1] AS evidence, '' AS proposal, false AS confident
  FROM (SELECT doc_id, n, unnest(range(1, len(n))) AS i FROM (SELECT doc_id, list_transform(regexp_extract_all(content, {D.q(pattern)}, 1), lambda x: CAST(x AS BIGINT)) AS n FROM kb)) WHERE n[i + 1] <> n[i] + 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1"""


_CLARITY = f"""{D.WITH_KB}, who AS (SELECT doc_id, content, coalesce('the ' || {_first_in(_CTX.actors)} || ' team', {_first_in(_CTX.products)}, heading, '') AS who, {_first_in(_CTX.actors)} IS NOT NULL OR {_first_in(_CTX.products)} IS NOT NULL AS sure FROM kb),
pron AS (SELECT doc_id, 0 AS part, ord, trim({D.sub('m', '^[.!?]?' + chr(92) + 's*', '')}) AS term, {D.evidence()} AS evidence FROM {D.matches('kb', 'doc_id', 'content', clarity._START)}
  UNION ALL SELECT doc_id, 1, i, lower(regexp_extract(s, {D.q(clarity._LAST_THEY)}, 1)), left(trim(s), 100) FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS s FROM (SELECT doc_id, {_SENTENCE_LIST} AS a FROM kb)) WHERE regexp_matches(s, {D.q(clarity._THEY)}) AND right(s, 1) IN ('.', '!', '?')),
known(acronym, usual) AS (VALUES {_KNOWN}),
acr AS (SELECT doc_id, ord, m, {D.evidence()} AS evidence FROM {_ACRONYM_PLACES} WHERE m NOT IN ({', '.join(map(D.q, EVERYDAY_ACRONYMS + NOT_ACRONYMS_IN_TEXT))}) AND len(list_filter(regexp_extract_all(content, {D.q(clarity._EXPANDED)}, 1), lambda d: suffix(d, m))) = 0
  QUALIFY row_number() OVER (PARTITION BY doc_id, m ORDER BY ord) = 1),
vague AS (SELECT doc_id, ord, m, {D.evidence()} AS evidence FROM {D.matches('kb', 'doc_id', 'content', clarity.VAGUE)} QUALIFY row_number() OVER (PARTITION BY doc_id, lower(m) ORDER BY ord) = 1),
ref AS (SELECT doc_id, ord, m, {D.evidence()} AS s FROM {D.matches('kb', 'doc_id', 'content', clarity.REFERENCE)}),
ref2 AS (SELECT doc_id, ord, s, {_REWORDED} AS n FROM ref),
long AS (SELECT doc_id, i, s FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS s FROM (SELECT doc_id, {D.sentences('content')} AS a FROM kb)) WHERE {D.word_count('s')} > {clarity.MOST_WORDS} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1),
every AS (SELECT doc_id, 0 AS kind, part * 1000000000 + ord AS ord, 'pronoun' AS issue, term, evidence, CASE WHEN sure THEN who ELSE '' END AS proposal, sure AS confident FROM pron JOIN who USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY part, ord) = 1
  UNION ALL SELECT doc_id, 1, ord, 'acronym', m, evidence, coalesce(m || ' (' || usual || ')', ''), usual IS NOT NULL FROM acr LEFT JOIN known ON m = acronym
  UNION ALL SELECT doc_id, 2, ord, 'vague_entity', m, evidence, CASE WHEN regexp_matches(lower(m), 'team|group|department') THEN '' ELSE 'Acme' END, NOT regexp_matches(lower(m), 'team|group|department') FROM vague
  UNION ALL SELECT doc_id, 3, ord, 'reference', s, s, CASE WHEN n <> s AND n <> '(remove)' THEN n ELSE '' END, n <> s AND n <> '(remove)' FROM ref2
  UNION ALL {_gap_sql(0, clarity._NUMBERED)} UNION ALL {_gap_sql(1, clarity._STEP)}
  UNION ALL SELECT doc_id, 5, 0, 'sentence', s, s, '', false FROM long)"""


@query(f"{_CLARITY} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, ord) - 1 AS INTEGER) AS ord, issue, term, evidence, proposal, confident FROM every")
def clarity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wording that can't be resolved."""
    return clarity.findings(kb(spark, sf_dir), _CTX)


@query(f"""{D.WITH_KB}, v AS (SELECT doc_id, ord, m AS term, {D.evidence()} AS evidence FROM {D.matches('kb', 'doc_id', 'content', clarity.VAGUE)})
SELECT doc_id, term, evidence FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY ord) = 1""")
def clarity_vague_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system, the team and so on, once a document each."""
    rows = structs(kb(spark, sf_dir), ("doc_id",), clarity.vague_entities("content", _CTX), "issue")
    return rows.select("doc_id", "term", "evidence")


@query(f"SELECT doc_id, sentence FROM ({D.WITH_KB}, s AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS sentence FROM (SELECT doc_id, {D.sentences('content')} AS a FROM kb)) SELECT * FROM s WHERE {D.word_count('sentence')} > 40 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)")
def clarity_long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of over forty words."""
    rows = structs(kb(spark, sf_dir), ("doc_id",), clarity.complex_sentence("content"), "issue")
    return rows.select("doc_id", F.col("term").alias("sentence"))


_LIST_OF = lambda issue: f"coalesce(list(term || chr(1) || proposal ORDER BY ord) FILTER (WHERE issue = '{issue}'), [])"
_FOLD = lambda c, fs, step: f"list_reduce(list_concat([{c}], {fs}), lambda acc, f: {step})"
_TERM, _PROPOSAL = "string_split(f, chr(1))[1]", "string_split(f, chr(1))[2]"
_OVERLAY = lambda at: f"CASE WHEN {at} > 0 THEN left(acc, {at} - 1) || {_PROPOSAL} || substr(acc, {at} + length({_TERM})) ELSE acc END"


@query(f"""{_CLARITY}, fx AS (SELECT doc_id, {_LIST_OF('acronym')} AS fa, {_LIST_OF('vague_entity')} AS fv, {_LIST_OF('reference')} AS fr FROM every WHERE confident AND proposal <> '' GROUP BY doc_id),
c0 AS (SELECT doc_id, content, coalesce(fa, []) AS fa, coalesce(fv, []) AS fv, coalesce(fr, []) AS fr, coalesce('the ' || list_filter({D.items(_CTX.actors)}, lambda a: contains(lower(heading), a))[1] || ' team', 'the Acme support team') AS who FROM kb LEFT JOIN fx USING (doc_id)),
c1 AS (SELECT * REPLACE ({_FOLD('content', 'fa', f"regexp_replace(acc, '{chr(92)}b' || {_TERM} || '{chr(92)}b', {_PROPOSAL})")} AS fa), content AS old FROM (SELECT doc_id, content, fa::VARCHAR[] AS fa, fv::VARCHAR[] AS fv, fr::VARCHAR[] AS fr, who FROM c0)),
c2 AS (SELECT doc_id, old, fv, fr, who, regexp_replace(fa, {D.q(f"(?i)({chr(92)}b{clarity._ASK}{chr(92)}s+)them{chr(92)}b")}, '{chr(92)}1' || who) AS c FROM c1),
c3 AS (SELECT * REPLACE (regexp_replace(c, '(?m)(^|[.!?]{chr(92)}s)They({chr(92)}s)', '{chr(92)}1' || CASE WHEN starts_with(c, 'They') THEN upper(left(who, 1)) || substr(who, 2) ELSE who END || '{chr(92)}2') AS c) FROM c2),
c4 AS (SELECT * REPLACE (regexp_replace(c, {D.q(f"(?i){chr(92)}bthey({chr(92)}s+{clarity._DO}{chr(92)}b)")}, who || '{chr(92)}1') AS c) FROM c3),
c5 AS (SELECT * REPLACE ({_FOLD('c', 'fv', _OVERLAY(f"strpos(lower(acc), lower({_TERM}))"))} AS c) FROM c4),
c6 AS (SELECT * REPLACE ({_FOLD('c', 'fr', _OVERLAY(f"strpos(acc, {_TERM})"))} AS c) FROM c5),
c7 AS (SELECT doc_id, c <> old AS clarity_fixed, CASE WHEN c <> old THEN {D.sub('trim(' + D.sub('c', T.SPACE + '{2,}', ' ') + ')', chr(92) + '.' + chr(92) + 's*' + chr(92) + '.', '.')} ELSE old END AS content FROM c6)
SELECT doc_id, content, {D.word_count('content')}::INTEGER AS words, clarity_fixed FROM c7""")
def clarity_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after repair."""
    return clarity.fix(clarity.with_findings(kb(spark, sf_dir), _CTX), _CTX).select("doc_id", "content", "words", "clarity_fixed")


_KEYS = f"""{D.WITH_KB}, w AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS word FROM (SELECT doc_id, {D.words('content', 4)} AS a FROM kb)),
n AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p FROM w WHERE word NOT IN ({', '.join(map(D.q, COMMON_CONTENT))}) GROUP BY ALL),
top AS (SELECT doc_id, word FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) <= 5),
keys AS (SELECT doc_id, word FROM top UNION SELECT doc_id, word FROM (SELECT doc_id, unnest({D.words('heading', 3)}) AS word FROM kb) WHERE word NOT IN ('the', 'and', 'for', 'with', 'from', 'updated', 'new', 'old', 'our'))"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb(spark, sf_dir).withColumnRenamed("doc_id", "chunk")


@query(f"{_KEYS} SELECT doc_id AS chunk, word FROM keys")
def consistency_topic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic words of every chunk."""
    return consistency.topic_keys(_chunks(spark, sf_dir))


_PAIRS = f"""{_KEYS}, size AS (SELECT word FROM keys GROUP BY word HAVING count(*) BETWEEN 2 AND 20), k AS (SELECT * FROM keys JOIN size USING (word)),
near AS (SELECT a.doc_id AS a, min(b.doc_id) AS b FROM kb a JOIN kb b ON b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 5 GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.word = y.word AND x.doc_id < y.doc_id UNION SELECT a, b FROM near)"""


@query(f"{_PAIRS} SELECT a, b FROM pairs")
def consistency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks worth comparing."""
    return consistency.candidate_pairs(_chunks(spark, sf_dir))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.prepared(temporal.enrich(_chunks(spark, sf_dir), TODAY), _CTX.actors, _CTX.scopes)


_FACTS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS kind, ord, m, {D.parts('lower(right(before, 40))', T.SPACE + '+')} AS w FROM {D.matches('kb', 'doc_id', 'content', p.replace('(?iU)', '(?i)'))}" for k, p in enumerate((consistency._NUMBER, consistency._PRICE)))
_FACTS = f"""SELECT doc_id AS chunk, kind, ord, regexp_extract(m, '[0-9]+([.][0-9]+)?') AS number,
  CASE WHEN kind = 0 THEN lower(trim(regexp_extract(m, '[^0-9. ].*$'))) ELSE '$' || replace(lower(regexp_extract(m, '(?i)/ *[a-z]+$')), ' ', '') END AS unit, w[-5:] AS context FROM ({_FACTS})"""


@query(f"{D.WITH_KB} SELECT chunk, number, unit, array_to_string(context, ' ') AS context FROM ({_FACTS})")
def consistency_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with a unit, and prices, and the words before them."""
    rows = structs(_chunks(spark, sf_dir), ("chunk",), consistency.facts("content"), "ord")
    return rows.select("chunk", "number", "unit", F.array_join("context", " ").alias("context"))


_SAYS = lambda c, n: f"left(coalesce(trim(list_filter({D.sentences(c)}, lambda s: contains(lower(s), lower({n})) AND contains(lower(s), lower(t.unit)))[1]), {c}), 200)"
_BOTH = lambda f, g: f"len(list_intersect(list_filter({f}, lambda x: NOT list_contains({D.items(GENERIC_CONTEXT)}, x)), list_filter({g}, lambda x: NOT list_contains({D.items(GENERIC_CONTEXT)}, x)))) >= 2"
_DUTIES = "len(list_intersect(string_split_regex(f.duty, ' +'), string_split_regex(g.duty, ' +'))) >= 2"


@query(f"""{_PAIRS}, facts AS ({_FACTS}), claims AS (SELECT doc_id AS chunk, ord, actor, duty FROM (SELECT doc_id, unnest(range(len(x))) AS ord, lower(unnest(x)) AS actor, trim(lower(unnest(y))) AS duty
    FROM (SELECT doc_id, regexp_extract_all(content, {D.q(consistency.CLAIM)}, 1) AS x, regexp_extract_all(content, {D.q(consistency.CLAIM)}, 2) AS y FROM kb)) WHERE list_contains({D.items(_CTX.actors)}, actor)),
told AS ({_DATES}), newest AS (SELECT doc_id, min(12 * (2026 - year) + 1 - month) AS date FROM told WHERE year BETWEEN 2015 AND 2030 AND month BETWEEN 1 AND 12 GROUP BY doc_id),
page AS (SELECT doc_id, 12 * (2026 - year(d)) + 1 - month(d) AS page FROM (SELECT doc_id, TRY_CAST(CASE WHEN contains(last_modified, 'T') THEN split_part(last_modified, 'T', 1) ELSE left(last_modified, 10) END AS DATE) AS d FROM kb)),
side AS (SELECT doc_id, content, author, page, date, regexp_extract_all(content, {D.q(consistency.STEP)}, 1) AS steps, list_distinct(list_filter({D.words('heading', 3)}, lambda x: NOT list_contains({D.items(COMMON_HEADING)}, x))) AS hw,
    coalesce('region=' || list_filter(['europe', 'asia'], lambda v: contains(lower(content || ' ' || heading), v))[1], '') AS scope FROM kb LEFT JOIN page USING (doc_id) LEFT JOIN newest USING (doc_id)),
num AS (SELECT a, b, f.number AS na, g.number AS nb, f.unit AS unit FROM pairs JOIN facts f ON f.chunk = a JOIN facts g ON g.chunk = b JOIN side x ON x.doc_id = a JOIN side y ON y.doc_id = b
    WHERE g.number <> f.number AND g.unit = f.unit AND f.unit <> '' AND {_BOTH('f.context', 'g.context')} AND (x.scope = '' OR y.scope = '' OR x.scope = y.scope) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY f.kind, f.ord, g.kind, g.ord) = 1),
aut AS (SELECT a, b, f.actor AS na, g.actor AS nb, '' AS unit FROM pairs JOIN claims f ON f.chunk = a JOIN claims g ON g.chunk = b WHERE g.actor <> f.actor AND {_DUTIES} QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY f.ord, g.ord) = 1
    UNION ALL SELECT f.chunk, f.chunk, f.actor, g.actor, '' FROM claims f JOIN claims g ON f.chunk = g.chunk AND g.ord > f.ord WHERE g.actor <> f.actor AND {_DUTIES} QUALIFY row_number() OVER (PARTITION BY f.chunk ORDER BY f.ord, g.ord) = 1),
pro AS (SELECT a, b, '' AS na, '' AS nb, '' AS unit FROM pairs JOIN side x ON x.doc_id = a JOIN side y ON y.doc_id = b WHERE len(x.steps) >= 2 AND len(y.steps) >= 2 AND list_has_any(x.hw, y.hw)
    AND len(list_intersect(string_split_regex(trim(lower(x.steps[1])), ' +')[1:5], string_split_regex(trim(lower(y.steps[1])), ' +')[1:5])) <= 1),
t AS (SELECT *, 'numeric' AS conflict FROM num UNION ALL SELECT *, 'authority' FROM aut ANTI JOIN num USING (a, b) UNION ALL SELECT *, 'process' FROM pro ANTI JOIN num USING (a, b) ANTI JOIN aut USING (a, b)),
ov AS (SELECT a, b, max(len(list_intersect(list_distinct(f.context), g.context))) AS ov FROM num JOIN facts f ON f.chunk = a JOIN facts g ON g.chunk = b GROUP BY ALL),
e AS (SELECT t.a, t.b, conflict, CASE WHEN conflict = 'process' THEN len(x.steps) || ' steps starting: ' || left(x.steps[1], 60) ELSE {_SAYS('x.content', 't.na')} END AS evidence_a, CASE WHEN conflict = 'process' THEN len(y.steps) || ' steps starting: ' || left(y.steps[1], 60) ELSE {_SAYS('y.content', 't.nb')} END AS evidence_b,
    CASE conflict WHEN 'numeric' THEN '"' || na || ' ' || unit || '" vs "' || nb || ' ' || unit || '" in a similar context' WHEN 'authority' THEN '"' || na || '" and "' || nb || '" have the same responsibility' ELSE 'same topic, different steps' END AS rationale,
    CASE WHEN x.page < y.page THEN 'a' WHEN y.page < x.page THEN 'b' WHEN x.date < y.date THEN 'a' WHEN y.date < x.date THEN 'b' ELSE '' END AS fresh, CASE WHEN x.author = 'Ann' AND y.author <> 'Ann' THEN 'a' WHEN y.author = 'Ann' AND x.author <> 'Ann' THEN 'b' ELSE '' END AS auth,
    CASE WHEN len(x.hw) > len(y.hw) + 1 THEN 'a' WHEN len(y.hw) > len(x.hw) + 1 THEN 'b' ELSE '' END AS head, coalesce(ov, 0) AS ov FROM t JOIN side x ON x.doc_id = t.a JOIN side y ON y.doc_id = t.b LEFT JOIN ov ON ov.a = t.a AND ov.b = t.b AND conflict = 'numeric'),
f AS (SELECT * REPLACE (CASE WHEN fresh <> '' OR auth <> '' THEN '' ELSE head END AS head) FROM e),
s AS (SELECT *, round(CASE WHEN fresh <> '' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN ov >= 3 THEN 0.2::DOUBLE WHEN ov = 2 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN auth <> '' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN head <> '' THEN 0.1::DOUBLE ELSE 0 END, 6) AS score FROM f)
SELECT a, b, conflict, evidence_a, evidence_b, rationale, CASE WHEN fresh <> '' THEN fresh WHEN auth <> '' THEN auth ELSE head END AS winner, score, {consistency.CONFIDENCE} AS confidence,
  CASE WHEN fresh <> '' THEN 'newer' WHEN auth <> '' THEN 'priority author' WHEN head <> '' THEN 'more specific heading' ELSE '' END AS reason FROM s""")
def consistency_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions with their score and winner."""
    p = kept(_prepared(spark, sf_dir), "prepared")  # both sides of each pair, evidence and scores read it
    return consistency.scored(consistency.conflicts(p, consistency.candidate_pairs(p)), p, priority_authors=["Ann"])


_T2 = f"(SELECT doc_id AS chunk, {D.words('content', 2)} AS w FROM kb)"


@query(f"""{D.WITH_KB}, c AS {_T2}, t AS (SELECT DISTINCT item_id AS question_id, unnest({D.words('text', 2)}) AS term FROM benchmark),
p AS (SELECT chunk, dl, term, count(*) AS f FROM (SELECT chunk, len(w) AS dl, unnest(w) AS term FROM c) GROUP BY ALL), a AS (SELECT greatest(avg(len(w)), 1) AS avgdl FROM c),
s AS (SELECT question_id, chunk, round(sum(f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM t JOIN p USING (term), a GROUP BY ALL)
SELECT question_id, chunk, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def eval_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents for each benchmark item."""
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return evaluation.bm25(asked, _chunks(spark, sf_dir))


@query("""WITH s AS (SELECT q.vec_id AS question_id, e.vec_id AS chunk, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
SELECT question_id, chunk, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def eval_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of all vectors to every vector whose id is divisible by 50, itself among them, by exact cosine."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return evaluation.cosine(asked, e.select(F.col("vec_id").alias("chunk"), "embedding"))


_OVERLAP = f"""{D.WITH_KB}, j AS (SELECT l.item_id, l.text AS expected_answer, k.doc_id, list_distinct({D.words('l.text', 2)}) AS e, {D.words('k.content', 2)} AS r FROM benchmark l JOIN kb k ON k.doc_id = l.item_id),
s AS (SELECT item_id, doc_id, CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_filter(e, lambda x: list_contains(r, x)))::DOUBLE / len(e) END AS sim FROM j),
v AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'answer_safe' ELSE 'caveat' END AS behavior, CASE WHEN sim >= 0.8 THEN 'correct' WHEN sim >= 0.6 THEN 'partial' ELSE 'incorrect' END AS after, CASE WHEN item_id % 2 = 0 THEN 'incorrect' ELSE 'correct' END AS before FROM s),
p AS (SELECT behavior, CASE after WHEN 'correct' THEN 1 WHEN 'partial' THEN 0.5 ELSE 0 END::DOUBLE AS a, CASE before WHEN 'correct' THEN 1 WHEN 'partial' THEN 0.5 ELSE 0 END::DOUBLE AS b FROM v)"""
_SIDE = "count(*) FILTER (WHERE {p} >= 0.7) / count(*)::DOUBLE AS recall_{s}, avg({p}) AS accuracy_{s}, count(*) FILTER (WHERE behavior = 'answer_safe' AND {p} >= 0.7) / nullif(count(*) FILTER (WHERE behavior = 'answer_safe'), 0)::DOUBLE AS safety_{s}, count(*) FILTER (WHERE behavior = 'caveat' AND {p} = 0) / nullif(count(*) FILTER (WHERE behavior = 'caveat'), 0)::DOUBLE AS hallucination_{s}, least(100, count(*) FILTER (WHERE {p} < 0.7) / count(*)::DOUBLE / 0.1 * 50)::DOUBLE AS risk_{s}"


@query(f"{_OVERLAP} SELECT behavior, count(*) AS total, {_SIDE.format(p='b', s='before')}, {_SIDE.format(p='a', s='after')} FROM p GROUP BY behavior")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged answers and the metrics they add up to, by behaviour."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("expected_answer"))
    pairs = item.join(kb(spark, sf_dir).select(F.col("doc_id").alias("item_id"), F.col("content").alias("retrieved")), "item_id")
    pairs = pairs.withColumn("behavior", F.expr("CASE item_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'answer_safe' ELSE 'caveat' END"))
    done = evaluation.judged(pairs).withColumnRenamed("verdict", "verdict_after").withColumn("verdict_before", F.expr("IF(item_id % 2 = 0, 'incorrect', 'correct')"))
    return evaluation.metrics(done, by=("behavior",))
