"""Steps that ask a language model. What the rules found stands where a model fails, says nothing, or says what can't be read.

Each takes ``call``, a function from text to text, which runs on the executors; whole texts are sent, one
question a row. Answers are read as JSON where more than a text is asked for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.rows import elements
from grainsieve.operators import consistency, evaluation, governance
from grainsieve.operators.domain import Context, overridden
from grainsieve.sources.files import call_model

Call = Callable[[str], str]
_JSON = "Answer with JSON only. "
TAG_OF = {d.name: d.tag for d in governance.detectors()} | {"destructive_domain": "destructive"}


def _list(answer: str, fields: str) -> Column:
    return F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), f"array<struct<{fields}>>")


def _object(answer: str, fields: str) -> Column:
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), f"struct<{fields}>")


def validated(chunks: DataFrame, call: Call, *, content_col: str = "content", found: str = "findings") -> DataFrame:
    """Governance findings without those that the model calls false, under the detectors that it names, and with what the rules missed."""
    names = ", ".join(sorted(TAG_OF))
    ask = T.quote(
        f"A rule-based scanner read this passage of a public knowledge base. Say for each numbered finding whether it is real, and add what it missed. {_JSON}"
        f'Give a list of objects: {{"finding": number or "new", "valid": true or false, "detector": one of {names}, "evidence": text, "reason": text}}.\n\nPassage:\n')
    item = "concat(i + 1, '. [', f.detector, '] ', f.evidence, ' - ', f.reason)"
    prompt = f"IF(size({found}) > 0, concat({ask}, {content_col}, '\\n\\nFindings:\\n', array_join(transform({found}, (f, i) -> {item}), '\\n')), NULL)"
    out = call_model(chunks.withColumn("_ask", F.expr(prompt)), "_ask", "_said", call).drop("_ask")
    out = out.withColumn("_said", F.coalesce(_list("_said", "finding string, valid boolean, detector string, evidence string, reason string"), F.expr("CAST(array() AS array<struct<finding:string,valid:boolean,detector:string,evidence:string,reason:string>>)")))
    tags = f"map({', '.join(T.quote(x) for kv in TAG_OF.items() for x in kv)})"
    named = lambda s: f"coalesce(try_element_at({tags}, {s}.detector), '')"
    verdict = "get(filter(_said, s -> s.finding = CAST(i + 1 AS string)), 0)"
    fields = lambda d, t, rest: f"named_struct('detector', {d}, 'tag', {t}, {rest})"
    kept = f"transform(filter(transform({found}, (f, i) -> struct(f AS f, {verdict} AS v)), x -> coalesce(x.v.valid, true)), x -> IF({named('x.v')} <> '', {fields('x.v.detector', named('x.v'), _REST_OLD)}, x.f))"
    new = f"transform(filter(_said, s -> lower(s.finding) = 'new' AND {named('s')} <> '' AND coalesce(s.evidence, '') <> ''), (s, i) -> {fields('s.detector', named('s'), _REST_NEW)})"
    return out.withColumn(found, F.expr(f"IF({found} IS NULL, NULL, concat({kept}, {new}))")).drop("_said")


_REST_OLD = "'evidence', x.f.evidence, 'matched', x.f.matched, 'reason', x.f.reason, 'ord', x.f.ord"
_REST_NEW = "'evidence', s.evidence, 'matched', s.evidence, 'reason', concat('model: ', coalesce(s.reason, '')), 'ord', 1099511627776L + i"


def remediated(chunks: DataFrame, call: Call, *, domain: str = "general", content_col: str = "content", heading_col: str = "heading", found: str = "findings") -> DataFrame:
    """Chunks with findings that block them, rewritten by the model without what was found; kept as they are where the answer is empty, over 1.3 times as long or still holds an e-mail address that was found.

    New columns: ``remediated``, and ``findings`` without those dealt with.
    """
    block = f"filter({found}, f -> {governance.priority_of('f.tag')} <= {governance.BLOCK_PRIORITY})"
    ask = T.quote(
        f"Edit this passage of a {domain} knowledge base so that customers can read it: replace people and their addresses by what they are, account numbers by [redacted], "
        "and drop internal remarks, drafts and placeholders. Change nothing else, and give only the passage.\n\nHeading: ")
    prompt = f"IF(size({block}) > 0, concat({ask}, {heading_col}, '\\n\\nFound:\\n', array_join(transform({block}, f -> concat('- [', f.tag, '] ', f.evidence)), '\\n'), '\\n\\nPassage:\\n', {content_col}), NULL)"
    out = call_model(chunks.withColumn("_ask", F.expr(prompt)), "_ask", "_said", call).drop("_ask").withColumn("_said", F.trim("_said"))
    good = f"_said <> '' AND {T.word_count('_said')} <= 1.3 * {T.word_count(content_col)} AND NOT exists({block}, f -> f.detector = 'pii_email' AND contains(_said, f.matched))"
    out = out.withColumn("remediated", F.expr(f"coalesce({good}, false)"))
    rest = f"filter({found}, f -> {governance.priority_of('f.tag')} > {governance.BLOCK_PRIORITY})"
    return out.withColumn(found, F.expr(f"IF(remediated, {rest}, {found})")).withColumn(content_col, F.expr(f"IF(remediated, _said, {content_col})")).drop("_said")


def resolved_terms(chunks: DataFrame, ctx: Context, call: Call, *, content_col: str = "content", heading_col: str = "heading", found: str = "clarity") -> DataFrame:
    """Clarity findings with what the model says pronouns and vague words stand for; sure where it is."""
    open_ = f"filter({found}, f -> f.issue IN ('pronoun', 'vague_entity'))"
    known = f"Company: {ctx.company_name or 'unknown'}. Teams: {', '.join(ctx.actors) or 'unknown'}. Products: {', '.join(ctx.products) or 'unknown'}."
    ask = T.quote(f'Say what each listed word of this passage refers to. {known} {_JSON}Give a list of objects: {{"term": word, "resolves_to": text, "confidence": "high", "medium" or "low"}}.\n\nHeading: ')
    prompt = f"IF(size({open_}) > 0, concat({ask}, coalesce({heading_col}, ''), '\\n\\nPassage:\\n', {content_col}, '\\n\\nWords:\\n', array_join(transform({open_}, f -> concat(f.term, ' in: ', f.evidence)), '\\n')), NULL)"
    out = call_model(chunks.withColumn("_ask", F.expr(prompt)), "_ask", "_said", call).drop("_ask")
    out = out.withColumn("_said", _list("_said", "term string, resolves_to string, confidence string"))
    told = "get(filter(coalesce(_said, array()), s -> s.term <> '' AND contains(lower(f.term), lower(s.term)) AND coalesce(s.resolves_to, '') <> ''), 0)"
    new = "named_struct('issue', x.f.issue, 'term', x.f.term, 'evidence', x.f.evidence, 'proposal', coalesce(x.s.resolves_to, x.f.proposal), 'confident', IF(x.s IS NULL, x.f.confident, coalesce(x.s.confidence, 'low') = 'high'))"
    return out.withColumn(found, F.expr(f"transform({found}, f -> transform(array(struct(f AS f, IF(f.issue IN ('pronoun', 'vague_entity'), {told}, NULL) AS s)), x -> {new})[0])")).drop("_said")


def rewritten_sentences(chunks: DataFrame, call: Call, *, keys: tuple[str, ...] = ("chunk",), found: str = "clarity") -> DataFrame:
    """Clarity findings with the model's wording of sentences that are too long or refer to what isn't there; sure where it says [HIGH]. One question a sentence."""
    rows = elements(chunks, keys, f"transform({found}, (f, i) -> struct(i AS i, f.issue AS issue, f.term AS term))", "f").where("f.issue IN ('reference', 'sentence') AND f.term <> ''")
    what = "IF(f.issue = 'reference', 'Drop the reference to another place and keep the meaning.', 'Split it into sentences of at most 30 words, with every fact kept.')"
    ask = T.quote(" End with [HIGH] if the meaning is fully kept, else [MEDIUM]. Give only the text.\n\n")
    said = call_model(rows.select(*keys, F.col("f.i").alias("_i"), F.expr(f"concat('Reword this sentence of a knowledge base. ', {what}, {ask}, f.term)").alias("_ask")), "_ask", "_said", call)
    said = said.where("trim(coalesce(_said, '')) <> ''").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_said"))).alias("_new"))
    text = "trim(regexp_replace(_new[i], '\\\\s*\\\\[(?:HIGH|MEDIUM|LOW)\\\\]\\\\s*', ' '))"
    new = f"named_struct('issue', f.issue, 'term', f.term, 'evidence', f.evidence, 'proposal', {text}, 'confident', contains(_new[i], '[HIGH]'))"
    return chunks.join(said, list(keys), "left").withColumn(found, F.expr(f"transform({found}, (f, i) -> IF(_new IS NOT NULL AND map_contains_key(_new, i), {new}, f))")).drop("_new")


def judged_conflicts(found: DataFrame, call: Call, *, domain: str = "general") -> DataFrame:
    """Contradictions without those that the model calls false, with the winners that it names and a score by its confidence. One question a finding."""
    ask = T.quote(f'Two passages of a {domain} knowledge base seem to contradict each other. Different topics or scopes are no contradiction. {_JSON}Give {{"valid": true or false, "winner": "a", "b" or "both", "reason": text, "confidence": "high", "medium" or "low"}}.\n\n')
    prompt = f"concat({ask}, conflict, ': ', rationale, '\\nA: ', evidence_a, '\\nB: ', evidence_b)"
    out = call_model(found.withColumn("_ask", F.expr(prompt)), "_ask", "_said", call).drop("_ask")
    out = out.withColumn("_said", _object("_said", "valid boolean, winner string, reason string, confidence string")).where("coalesce(_said.valid, true)")
    sure = "CASE _said.confidence WHEN 'high' THEN 0.8D WHEN 'medium' THEN 0.5D ELSE 0D END"
    picked = "_said.winner IN ('a', 'b')"
    out = out.withColumn("winner", F.expr(f"CASE WHEN {picked} THEN _said.winner WHEN _said.winner = 'both' THEN '' ELSE winner END"))
    out = out.withColumn("reason", F.expr(f"IF({picked}, concat('model: ', coalesce(_said.reason, '')), reason)")).withColumn("score", F.expr(f"IF({picked}, greatest(score, {sure}), score)"))
    return out.withColumn("confidence", F.expr(consistency.CONFIDENCE)).drop("_said")


def headings(sections: DataFrame, call: Call) -> DataFrame:
    """Sections that rules named anew, with the model's heading where it has two to eight words."""
    ask = T.quote("Give a heading of three to six words for this section, by which a reader would look for it. Give only the heading.\n\n")
    out = call_model(sections.withColumn("_ask", F.expr(f"IF(heading_source <> 'original', concat({ask}, {T.cell('content')}), NULL)")), "_ask", "_said", call).drop("_ask")
    out = out.withColumn("_said", F.expr("""trim(regexp_replace(_said, '^[\\\\s"\\'#]+|[\\\\s"\\'#]+$', ''))"""))
    good = f"{T.word_count('_said')} BETWEEN 2 AND 8"
    return out.withColumn("new_heading", F.expr(f"IF({good}, _said, new_heading)")).withColumn("heading_source", F.expr(f"IF({good}, 'generated_model', heading_source)")).drop("_said")


def described(rows: DataFrame, kind: str, call: Call) -> DataFrame:
    """Tables, figures or procedures with the model's summary in place of the rules'; figures without a description get one that says what the caption shows."""
    ask = T.quote(f"Say in one sentence what this {kind} of a knowledge base tells a reader. Give only the sentence.\n\n")
    out = call_model(rows.withColumn("_ask", F.expr(f"concat({ask}, coalesce(heading, ''), '\\n', content)")), "_ask", "_said", call).drop("_ask")
    return out.withColumn("summary", F.expr("coalesce(nullif(rtrim('.', trim(_said)), ''), summary)")).drop("_said")


def verdicts(pairs: DataFrame, call: Call, *, unclear_only: bool = False) -> DataFrame:
    """``pairs`` with the model's ``verdict`` on what was retrieved; with ``unclear_only``, of those that the rules call partial."""
    ask = T.quote('Does the retrieved text answer the question as expected? Correct: it has the key facts. Partial: right topic, most facts missing. Incorrect: another topic, or personal or internal content. ' + _JSON + 'Give {"verdict": "correct", "partial" or "incorrect"}.\n\nQuestion: ')
    which = "behavior <> 'block' AND retrieved IS NOT NULL" + (" AND verdict = 'partial'" if unclear_only else "")
    prompt = f"IF({which}, concat({ask}, question, '\\n\\nExpected: ', expected_answer, '\\n\\nRetrieved: ', retrieved), NULL)"
    out = call_model(pairs.withColumn("_ask", F.expr(prompt)), "_ask", "_said", call).drop("_ask").withColumn("_said", _object("_said", "verdict string")["verdict"])
    return out.withColumn("verdict", F.expr("IF(_said IN ('correct', 'partial', 'incorrect'), _said, verdict)")).drop("_said")


def inferred(ctx: Context, preview: list[str], call: Call, *, only: bool = False) -> Context:
    """The context with what the model says of a preview of the corpus; with ``only``, in place of what the rules found."""
    ask = f'What is this corpus about? {_JSON}Give {{"domain_type": word, "company_name": text, "actors": [...], "acronyms": {{short: long}}, "products": [...], "destructive": [...]}}.\n\n'
    try:
        said = json.loads(re.search(r"(?s)\{.*\}", call(ask + "\n".join(preview)))[0])
        texts = lambda k: [x for x in said.get(k) or [] if isinstance(x, str)]
        short = {k: v for k, v in (said.get("acronyms") or {}).items() if isinstance(v, str)}
        kind, company = (v if isinstance(v := said.get(k), str) else "" for k in ("domain_type", "company_name"))
    except Exception:  # the rules' result stands where a model fails
        return ctx
    base = replace(ctx, actors=[], acronyms={}, products=[], destructive=[]) if only else ctx
    return overridden(base, domain_type=kind, company_name=company, actors=[a.lower() for a in texts("actors")], acronyms=short, products=texts("products"), destructive=[x.lower() for x in texts("destructive")])


def by_vectors(pairs: DataFrame, a: str, b: str) -> str:
    """Expression of the cosine of two columns of vectors, or of the overlap of words where one is missing."""
    norm = lambda v: f"sqrt(aggregate({v}, 0D, (s, x) -> s + CAST(x AS double) * x))"
    dot = f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS double) * y), 0D, (s, x) -> s + x)"
    return f"IF({a} IS NULL OR {b} IS NULL, {evaluation.overlap('expected_answer', 'retrieved')}, coalesce(try_divide({dot}, {norm(a)} * {norm(b)}), 0D))"
