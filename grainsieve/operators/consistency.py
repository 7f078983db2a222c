"""Contradictions between chunks: numbers, responsibilities and procedures that don't agree.

Pairs worth comparing share a topic word that few chunks have, or are neighbours. Facts, claims and steps are
taken from each chunk once and joined to the pairs; evidence is looked up for findings only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.rows import elements, structs
from grainsieve.functions.vocabulary import COMMON_CONTENT, COMMON_HEADING, GENERIC_CONTEXT

CONFIDENCE = "CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END"
GROUP = (2, 20)
REACH = 5
TOP = 5
_NUMBER = r"(?iU)\b(\d+(?:\.\d+)?)\s*(weeks?|percent|months?|hours?|euros?|dollars?|days?|business\s+days?|%)"
_PRICE = r"(?i)\$(\d+(?:\.\d+)?)\s*(?:/\s*(year|yr|month|mo|hour|day))?"
CLAIM = r"(?i)\b(\w+)\s+" + T.any_of("reviews?", "processes?", "owns?", "manages?", "handles?", "approves?") + r"\s+(?:all\s+)?([a-z\s]+?)(?:\.|,|;|$)"
STEP = r"(?:^|\s)(?:Step \d+:\s*|\d+[.)]\s+)([^.!?\n]+)"


def heading_words(h: str) -> str:
    return f"array_except(array_distinct({T.words(h, 3)}), {T.array_of(COMMON_HEADING)})"


def _as_words(text: bytes) -> list[bytes]:
    """Words of lower case, cut as ``T.words`` cuts them, of all lengths and letters: those of a to z are told by ``isalpha``."""
    if not text.isascii():
        # other letters and numbers hold a word together as they are; the rest cuts
        chars, whole = text.translate(None, _ASCII).decode("utf-8", "replace"), text.decode("utf-8", "replace")
        if not chars.isalnum() or "\ufffd" in whole or not _FOLDED.isdisjoint(chars):
            text = _CUTS.sub(" ", whole.lower()).encode()
    return text.translate(_LOWER).split()


_ASCII = bytes(range(128))
_LOWER = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in _ASCII.lower() + bytes(range(128, 256)))
_CUTS = re.compile(r"[^\x00-\x7f\w]")
_FOLDED = frozenset("\u0130\u212a")  # lower case of these is of a to z


def top_words(text: bytes, k: int, ignored: frozenset[bytes], least: int = 4) -> list[str]:
    """The k most frequent words, ties by first place."""
    n = Counter(_as_words(text))
    fits = lambda w: len(w) >= least and w.isalpha() and w not in ignored
    best = sorted(((c, w) for w, c in n.items() if c > 1 and fits(w)), key=lambda x: -x[0])[:k]
    if len(best) < k:  # most words of a text stand there once: they come in their order, unsorted
        best += islice(((c, w) for w, c in n.items() if c == 1 and fits(w)), k - len(best))
    return [w.decode() for _, w in best]


#: Keys are dealt by so many to find neighbours; topics are letters only, so that this sign tells such a group.
_SPAN, _NEAR = 1024, "#"


def _words_by_row(chunks: DataFrame, key: str, content_col: str, heading_col: str | None = None, *, k: int = TOP, stop: list[str] = COMMON_CONTENT, reach: int = 0) -> DataFrame:
    """(key, word, rank) of one pass over the texts: the most frequent words from rank 1, words of the heading of rank 0, and with ``reach`` groups of near keys of rank -1."""
    named = F.expr(f"array_join({heading_words(heading_col)}, ' ')") if heading_col else F.lit(None).cast("string")
    rows = chunks.select(F.col(key).alias("key"), F.col(content_col).alias("c"), named.alias("h"))
    ignored = frozenset(w.encode() for w in stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, words, ranks = [], [], []
            keys = batch.column(0) if reach else ()
            for i, (text, h) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2))):
                own = [(w, 0) for w in (h.as_py() or "").split()]
                own += [(w, r) for r, w in enumerate(top_words(text.as_py() or b"", k, ignored), 1)]
                if reach and (n := keys[i].as_py()) is not None:
                    own += [(f"{_NEAR}{g}", -1) for g in {n // _SPAN, (n - reach) // _SPAN}]
                places += [i] * len(own)
                words += [w for w, _ in own]
                ranks += [r for _, r in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(words, pa.string()), pa.array(ranks, pa.int32())], names=["key", "word", "rank"])

    out = rows.mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, word string, rank int")
    repeated = F.broadcast(chunks.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k", F.lit(True).alias("_again")))  # ids, as a rule none
    w = elements(chunks.join(repeated, F.col(key).eqNullSafe(F.col("_k")), "left_semi"), (key,), T.words(content_col, 4), "word", "pos").where(~F.col("word").isin(stop))
    n = w.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    n = n.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= k).select(key, "word", "rank")
    out = out.join(repeated, F.col("key").eqNullSafe(F.col("_k")), "left").where("_again IS NULL OR rank < 1").select(F.col("key").alias(key), "word", "rank")
    return out.unionByName(n)


def content_words(chunks: DataFrame, *, key: str = "chunk", content_col: str = "content", k: int = TOP, stop: list[str] = COMMON_CONTENT) -> DataFrame:
    """(key, word, rank): the k most frequent words of each chunk, ties by first place; counted within the row, so that words aren't shuffled.

    Rows of one key count as one chunk; where keys repeat, their words alone are counted by shuffle.
    """
    return _words_by_row(chunks, key, content_col, k=k, stop=stop)


def topic_keys(chunks: DataFrame, *, key: str = "chunk", content_col: str = "content", heading_col: str = "heading") -> DataFrame:
    """(key, word): words of the heading and the most frequent ones of the content."""
    return _words_by_row(chunks, key, content_col, heading_col).select(key, "word").distinct()


def active(chunks: DataFrame, content_col: str = "content") -> DataFrame:
    """Chunks with words that aren't placeholders or editorial."""
    out = chunks.where(F.expr(f"trim({content_col}) <> ''"))
    return out.where("tag not in ('editorial', 'placeholder')") if "tag" in chunks.columns else out


def candidate_pairs(chunks: DataFrame, *, key: str = "chunk", content_col: str = "content", heading_col: str = "heading", group: tuple[int, int] = GROUP, reach: int = REACH) -> DataFrame:
    """(a, b) with a < b: chunks in a topic of ``group`` many, and neighbours in the order of ``key`` no further than ``reach`` apart.

    Texts are read once: neighbours come from groups of near keys, each with the first keys of the next, made in the pass that makes topics. No window over everything.
    """
    on = active(chunks, content_col)
    # by word, so that one shuffle serves: rows of a key and word meet there, and so does the topic
    keys = _words_by_row(on, key, content_col, heading_col, reach=reach).select(key, "word").repartition("word").distinct()
    # the size of a topic is part of what a pair is: larger ones say nothing
    # both sides of a pair come from the list of a topic, which has at most as many as ``group`` allows
    w = Window.partitionBy("word")
    kept = keys.withColumn("_n", F.count("*").over(w)).where(F.col("_n").between(*group) | F.col("word").startswith(_NEAR)).groupBy("word").agg(F.array_sort(F.collect_list(key)).alias("k"))
    near = f"filter(transform(k, (a, i) -> struct(a AS a, get(k, i + 1) AS b)), p -> p.b - p.a <= {reach})"
    topic = "flatten(transform(k, (a, i) -> transform(slice(k, i + 2, size(k)), b -> struct(a AS a, b AS b))))"
    return structs(kept, (), f"IF(startswith(word, '{_NEAR}'), {near}, {topic})", "a").distinct()


def facts(c: str) -> str:
    """Array of (ord, number, unit, context): numbers with a unit, and prices; context is the last five words before."""
    context = f"transform(array({T.pieces('lower(right(m.before, 40))', T.SPACE + '+')}), w -> slice(w, greatest(1, size(w) - 4), 5))[0]"
    n = f"transform({T.matches(c, _NUMBER)}, m -> struct(CAST(m.ord AS bigint) AS ord, regexp_extract(m.match, {T.quote(_NUMBER)}, 1) AS number, lower(regexp_extract(m.match, {T.quote(_NUMBER)}, 2)) AS unit, {context} AS context))"
    period = f"lower(regexp_extract(m.match, {T.quote(_PRICE)}, 2))"
    p = f"transform({T.matches(c, _PRICE)}, m -> struct(4294967296L + m.ord AS ord, regexp_extract(m.match, {T.quote(_PRICE)}, 1) AS number, IF({period} = '', '$', '$/' || {period}) AS unit, {context} AS context))"
    return f"concat({n}, {p})"


def scope(c: str, heading: str, scopes: dict[str, list[str]]) -> str:
    """Map of the first value of each kind that a chunk names."""
    both = f"lower(concat({c}, ' ', {heading}))"
    each = ", ".join(f"named_struct('k', {T.quote(k)}, 'v', get(filter({T.array_of([v.lower() for v in vs])}, v -> contains({both}, v)), 0))" for k, vs in scopes.items() if vs)
    return f"array_join(transform(filter(array({each}), x -> x.v IS NOT NULL), x -> x.k || '=' || x.v), ';')" if each else "''"


def prepared(chunks: DataFrame, actors: list[str] = (), scopes: dict[str, list[str]] | None = None, *, content_col: str = "content", heading_col: str = "heading") -> DataFrame:
    """``chunks`` with facts, claims, steps, scope and heading words."""
    told = f"transform(arrays_zip(regexp_extract_all({content_col}, {T.quote(CLAIM)}, 1), regexp_extract_all({content_col}, {T.quote(CLAIM)}, 2)), (x, i) -> struct(i AS ord, lower(x['0']) AS actor, trim(lower(x['1'])) AS duty))"
    return (
        chunks.withColumn("facts", F.expr(facts(content_col))).withColumn("claims", F.expr(f"filter({told}, x -> array_contains({T.array_of(list(actors))}, x.actor))"))
        .withColumn("steps", F.expr(f"regexp_extract_all({content_col}, {T.quote(STEP)}, 1)")).withColumn("scope", F.expr(scope(content_col, heading_col, scopes or {})))
        .withColumn("heading_words", F.expr(heading_words(heading_col)))
    )


_BARE = f"array_except(array_distinct({{}}), {T.array_of(GENERIC_CONTEXT)})"
_NUMERIC = (
    "filter(flatten(transform(x.facts, f -> transform(filter(y.facts, g -> g.number <> f.number AND g.unit = f.unit AND f.unit <> '' AND "
    f"size(array_intersect({_BARE.format('f.context')}, {_BARE.format('g.context')})) >= 2), g -> struct(f.number AS na, g.number AS nb, f.unit AS unit)))), z -> x.scope = '' OR y.scope = '' OR x.scope = y.scope)"
)
_DUTY = "size(array_intersect(split({}.duty, ' +'), split({}.duty, ' +'))) >= 2"
_AUTHORITY = f"flatten(transform(x.claims, f -> transform(filter(y.claims, g -> g.actor <> f.actor AND {_DUTY.format('f', 'g')}), g -> struct(f.actor AS na, g.actor AS nb, '' AS unit))))"
_PROCESS = "size(x.steps) >= 2 AND size(y.steps) >= 2 AND size(x.heading_words) > 0 AND arrays_overlap(x.heading_words, y.heading_words) AND size(array_intersect(slice(split(trim(lower(x.steps[0])), ' +'), 1, 5), slice(split(trim(lower(y.steps[0])), ' +'), 1, 5))) <= 1"


def sentence_with(c: str, token: str, other: str, most: int = 200) -> str:
    """The first sentence that has both tokens, else the beginning."""
    return f"coalesce(left(trim(get(filter({T.sentences(c, False)}, s -> contains(lower(s), lower({token})) AND contains(lower(s), lower({other}))), 0)), {most}), left({c}, {most}))"


def conflicts(chunks: DataFrame, pairs: DataFrame, *, key: str = "chunk", content_col: str = "content") -> DataFrame:
    """One finding a pair at most, numbers before responsibilities before procedures: a, b, conflict, evidence_a, evidence_b, rationale.

    ``chunks`` are ``prepared``. A chunk that contradicts itself about a responsibility is a pair of its own.
    """
    # only chunks with something to contradict; texts stay behind until there's a finding
    slim = chunks.select(F.col(key).alias("id"), F.struct("facts", "claims", "steps", "scope", "heading_words").alias("x")).where("size(x.facts) > 0 OR size(x.claims) > 0 OR size(x.steps) >= 2")
    both = pairs.join(slim.select(F.col("id").alias("a"), "x"), "a").join(slim.select(F.col("id").alias("b"), F.col("x").alias("y")), "b")
    found = both.select("a", "b", F.expr(f"get({_NUMERIC}, 0)").alias("n"), F.expr(f"get({_AUTHORITY}, 0)").alias("u"), F.expr(_PROCESS).alias("p"), F.expr("size(x.steps)").alias("sa"), F.expr("left(get(x.steps, 0), 60)").alias("fa"), F.expr("size(y.steps)").alias("sb"), F.expr("left(get(y.steps, 0), 60)").alias("fb"))
    found = found.withColumn("conflict", F.expr("CASE WHEN n IS NOT NULL THEN 'numeric' WHEN u IS NOT NULL THEN 'authority' WHEN p THEN 'process' END")).where("conflict IS NOT NULL")
    own = slim.where("size(x.claims) > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.expr(f"get(flatten(transform(x.claims, f -> transform(filter(x.claims, g -> g.ord > f.ord AND g.actor <> f.actor AND {_DUTY.format('f', 'g')}), g -> struct(f.actor AS na, g.actor AS nb, '' AS unit)))), 0)").alias("u")).where("u IS NOT NULL").withColumn("conflict", F.lit("authority"))
    found = found.unionByName(own, allowMissingColumns=True).withColumn("t", F.coalesce("n", "u"))
    text = chunks.select(F.col(key).alias("id"), F.col(content_col).alias("c"))
    out = found.join(text.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(text.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    side = lambda c, n, s, f: F.expr(f"IF(conflict = 'process', {s} || ' steps starting: ' || {f}, {sentence_with(c, 't.' + n, 't.unit')})")
    why = F.expr("CASE conflict WHEN 'numeric' THEN concat('\"', t.na, ' ', t.unit, '\" vs \"', t.nb, ' ', t.unit, '\" in a similar context') WHEN 'authority' THEN concat('\"', t.na, '\" and \"', t.nb, '\" have the same responsibility') ELSE 'same topic, different steps' END")
    return out.select("a", "b", "conflict", side("ca", "na", "sa", "fa").alias("evidence_a"), side("cb", "nb", "sb", "fb").alias("evidence_b"), why.alias("rationale"))


def scored(found: DataFrame, chunks: DataFrame, *, key: str = "chunk", priority_authors: list[str] = ()) -> DataFrame:
    """Findings with ``score``, ``confidence``, ``winner`` (a, b or empty) and ``reason``.

    Newer pages and dates add 0.3 and win; shared context 0.2 (three words) or 0.1 (two); an author of priority 0.2; a more specific heading 0.1 where nothing else decides.
    """
    opt = lambda c, kind: F.col(c) if c in chunks.columns else F.lit(None).cast(kind)
    newest = F.col("newest_date.age_months") if "newest_date" in chunks.columns else F.lit(None).cast("int")
    side = chunks.select(F.col(key).alias("id"), F.struct(opt("page_age_months", "int").alias("page"), newest.alias("date"), opt("author", "string").alias("author"), F.size("heading_words").alias("hw"), F.expr("transform(facts, f -> array_distinct(f.context))").alias("ctx")).alias("s"))
    out = found.join(side.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(side.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    out = out.withColumn("_fresh", F.expr("CASE WHEN x.page < y.page THEN 'a' WHEN y.page < x.page THEN 'b' WHEN x.date < y.date THEN 'a' WHEN y.date < x.date THEN 'b' ELSE '' END"))
    out = out.withColumn("_ov", F.expr("IF(conflict = 'numeric', coalesce(array_max(flatten(transform(x.ctx, p -> transform(y.ctx, q -> size(array_intersect(p, q)))))), 0), 0)"))
    first = T.array_of(list(priority_authors))
    out = out.withColumn("_auth", F.expr(f"transform(array(struct(coalesce(array_contains({first}, x.author), false) AS p, coalesce(array_contains({first}, y.author), false) AS q)), z -> CASE WHEN z.p AND NOT z.q THEN 'a' WHEN z.q AND NOT z.p THEN 'b' ELSE '' END)[0]"))
    out = out.withColumn("_head", F.expr("IF(_fresh <> '' OR _auth <> '', '', CASE WHEN x.hw > y.hw + 1 THEN 'a' WHEN y.hw > x.hw + 1 THEN 'b' ELSE '' END)"))
    out = out.withColumn("winner", F.expr("CASE WHEN _fresh <> '' THEN _fresh WHEN _auth <> '' THEN _auth ELSE _head END"))
    out = out.withColumn("score", F.expr("round(IF(_fresh <> '', 0.3D, 0D) + CASE WHEN _ov >= 3 THEN 0.2D WHEN _ov = 2 THEN 0.1D ELSE 0D END + IF(_auth <> '', 0.2D, 0D) + IF(_head <> '', 0.1D, 0D), 6)"))
    out = out.withColumn("confidence", F.expr(CONFIDENCE))
    out = out.withColumn("reason", F.expr("CASE WHEN _fresh <> '' THEN 'newer' WHEN _auth <> '' THEN 'priority author' WHEN _head <> '' THEN 'more specific heading' ELSE '' END"))
    return out.drop("x", "y", "_fresh", "_ov", "_auth", "_head")


def resolve(chunks: DataFrame, found: DataFrame, *, key: str = "chunk", content_col: str = "content", threshold: float = 0.7) -> DataFrame:
    """Chunks without the sentences that lose: the first that holds the evidence of a finding whose score reaches ``threshold``; a chunk never loses all it has."""
    lost = found.where((F.col("score") >= threshold) & (F.col("winner") != "")).select(F.expr("IF(winner = 'a', b, a)").alias(key), F.expr("lower(left(IF(winner = 'a', evidence_b, evidence_a), 60))").alias("e"), F.struct("a", "b").alias("o"))
    lost = lost.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "e"))).alias("_lost"))
    at = "array_position(transform(s, t -> contains(lower(t), f.e)), true)"
    left = f"aggregate(_lost, {T.sentences(content_col, False)}, (s, f) -> IF(size(s) > 1 AND {at} > 0, filter(s, (t, i) -> i + 1 <> {at}), s))"
    out = chunks.join(lost, key, "left").withColumn("auto_resolved", F.expr(f"_lost IS NOT NULL AND array_join({left}, ' ') <> array_join({T.sentences(content_col, False)}, ' ')"))
    return out.withColumn(content_col, F.expr(f"IF(auto_resolved, array_join({left}, ' '), {content_col})")).drop("_lost")


def decide(chunks: DataFrame, found: DataFrame, decisions: DataFrame | None = None, *, key: str = "chunk", bulk_accept: bool = False) -> DataFrame:
    """Chunks after decisions (a, b, decision: select_a, select_b, keep_both): losers are stale; undecided and kept pairs leave a caveat on both, in ``conflicts``."""
    d = found
    if decisions is not None:
        d = d.join(decisions.select("a", "b", "decision"), ["a", "b"], "left")
    else:
        d = d.withColumn("decision", F.lit(None).cast("string"))
    if bulk_accept:
        d = d.withColumn("decision", F.coalesce("decision", F.expr("IF(winner <> '', concat('select_', winner), NULL)")))
    losers = d.where("decision in ('select_a', 'select_b')").select(F.expr("IF(decision = 'select_a', b, a)").alias(key)).distinct().withColumn("_lost", F.lit(True))
    kept = d.where("decision IS NULL OR decision NOT IN ('select_a', 'select_b')")
    sides = kept.select(F.col("a").alias(key), F.struct("conflict", F.col("b").alias("with"), F.col("evidence_b").alias("evidence"), "rationale").alias("c")).unionByName(kept.where("a <> b").select(F.col("b").alias(key), F.struct("conflict", F.col("a").alias("with"), F.col("evidence_a").alias("evidence"), "rationale").alias("c")))
    notes = sides.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("conflicts"))
    out = chunks.join(losers, key, "left").join(notes, key, "left")
    tag = F.col("tag") if "tag" in chunks.columns else F.lit("content")
    return out.withColumn("tag", F.when(F.col("_lost"), "stale").otherwise(tag)).drop("_lost")
