"""What a corpus is about: its vocabulary, domain, company, actors, acronyms, products, scopes and risky actions.

Every inventory is an aggregate over all chunks; the order of first appearance, where it matters, is carried
as a sort key. ``infer`` gathers them into a small context; what grows with the corpus (actors, acronyms,
anchors) can also be joined as a table, which the other operators do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.rows import elements, structs
from grainsieve.functions.vocabulary import COMMON_CORPUS, DOMAINS, EVERYDAY_ACRONYMS, EXPANSIONS, NOT_ACRONYMS, NOT_ACTORS, TITLE_WORDS

KEYS = ("doc_id",)


@dataclass
class Context:
    """What the other operators know of a corpus. Maps keep the order of first appearance."""

    domain_type: str = "general"
    confidence: float = 0.0
    company_name: str = ""
    actors: list[str] = field(default_factory=list)
    acronyms: dict[str, str] = field(default_factory=dict)
    products: list[str] = field(default_factory=list)
    scopes: dict[str, list[str]] = field(default_factory=dict)
    destructive: list[str] = field(default_factory=list)
    anchors: dict[str, list[str]] = field(default_factory=dict)

    @property
    def normalization(self) -> dict[str, str]:
        """Other words of a topic to its most frequent one."""
        return {w: a for a, ws in self.anchors.items() for w in ws if w != a}

    @property
    def detected(self) -> int:
        return sum(map(len, (self.actors, self.acronyms, self.products, self.scopes, self.destructive, self.anchors)))


def word_frequencies(chunks: DataFrame, *, content_col: str = "content") -> DataFrame:
    """(word, n): words of four or more letters but common ones."""
    words = elements(chunks, (), T.words(content_col, 4), "word")
    return words.where(~F.col("word").isin(COMMON_CORPUS)).groupBy("word").agg(F.count("*").alias("n"))


def domain_scores(frequencies: DataFrame) -> DataFrame:
    """(domain, ord, score) of every domain."""
    spark = frequencies.sparkSession
    signals = spark.createDataFrame([(d, i, w) for i, (d, ws) in enumerate(DOMAINS) for w in ws.split()], "domain string, ord int, word string")
    return F.broadcast(signals).join(frequencies, "word", "left").groupBy("domain", "ord").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("score"))  # 65 rows


def domain_type(scores: DataFrame) -> DataFrame:
    """One row: the best domain (ties: the first) and its share; general and 0 without any signal."""
    best = scores.agg(F.sum("score").alias("total"), F.max_by("domain", F.struct("score", -F.col("ord"))).alias("best"), F.max("score").alias("top"))
    return best.select(F.expr("IF(total > 0, best, 'general')").alias("domain_type"), F.expr("round(IF(total > 0, top / total, 0D), 2)").alias("confidence"))


def _found(chunks: DataFrame, patterns: list[tuple[str, int]], content_col: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, which, pos, found): groups of the matches of several patterns, with an order of appearance."""
    each = ", ".join(f"transform(regexp_extract_all({content_col}, {T.quote(p)}, {g}), (x, i) -> struct({k} AS which, i AS pos, x AS found))" for k, (p, g) in enumerate(patterns))
    return structs(chunks, keys, f"concat({each})", "which")


def company_candidates(chunks: DataFrame, *, content_col: str = "content", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(name, n, first): capitalised phrases of more than three characters."""
    found = _found(chunks, [(r"(?U)\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)*)\b", 1)], content_col, keys)
    found = found.where((F.length("found") > 3) & ~F.col("found").isin(TITLE_WORDS))
    return found.groupBy(F.col("found").alias("name")).agg(F.count("*").alias("n"), F.min(F.struct(*keys, "pos")).alias("first"))


def company_of_title(title: str | None) -> str:
    head = re.split(r"\s*[-–—|:]\s*", title or "")[0].strip()
    return head if head[:1].isupper() and head.lower() not in COMMON_CORPUS else ""


_TEAM = T.any_of("team", "group", "division", "department")
ACTOR_PATTERNS = [
    (r"(?iU)\b(?:the\s+)?(\w+)\s+" + _TEAM + r"\b", 1),
    (r"(?iU)\b(\w+)\s+" + T.any_of("reviews?", "processes?", "manages?", "handles?", "approves?") + r"\b", 1),
    (r"(?iU)\b(?:contact|escalate\s+to)\s+(?:the\s+)?(\w+)\s*(?:department|team)?\b", 1),
    (r"(?iU)\b(\w+)\s+" + T.any_of("issues", "inquiries", "escalations", "disputes") + r"\b", 1),
]


def actors(chunks: DataFrame, *, least: int = 2, content_col: str = "content", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(actor, n, first): who does something, seen at least ``least`` times."""
    found = _found(chunks, ACTOR_PATTERNS, content_col, keys).withColumn("actor", F.lower("found"))
    found = found.where((F.length("actor") > 2) & ~F.col("actor").isin(NOT_ACTORS))
    return found.groupBy("actor").agg(F.count("*").alias("n"), F.min(F.struct(*keys, "which", "pos")).alias("first")).where(F.col("n") >= least)


def acronyms(chunks: DataFrame, *, content_col: str = "content", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(acronym, n, expansion): an expansion from the text (the last), else a well-known one, else null if seen three times; others are left out."""
    seen = _found(chunks, [(r"(?U)\b([A-Z]{2,5})\b(?!-\d)", 1)], content_col, keys).where(~F.col("found").isin(EVERYDAY_ACRONYMS + NOT_ACRONYMS))
    seen = seen.groupBy(F.col("found").alias("acronym")).agg(F.count("*").alias("n"))
    name_first, acronym_first = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*\(([A-Z]{2,6})\)", r"([A-Z]{2,6})\s*\(([A-Z][a-z]+(?:\s+[a-zA-Z]+)*)\)"
    both = ", ".join(f"transform(arrays_zip(regexp_extract_all({content_col}, {T.quote(p)}, {a}), regexp_extract_all({content_col}, {T.quote(p)}, {e})), (x, i) -> struct(x['0'] AS acronym, x['1'] AS expansion, {k} AS which, i AS pos))" for k, (p, a, e) in enumerate(((name_first, 2, 1), (acronym_first, 1, 2))))
    told = structs(chunks, keys, f"concat({both})", "pos").groupBy("acronym").agg(F.max_by("expansion", F.struct(*keys, "which", "pos")).alias("told"))
    known = F.create_map(*[F.lit(x) for kv in EXPANSIONS.items() for x in kv])
    out = seen.join(told, "acronym", "left").withColumn("expansion", F.coalesce("told", F.try_element_at(known, F.col("acronym"))))
    return out.where("expansion is not null or n >= 3").select("acronym", "n", "expansion")


_TIERS = T.any_of("Starter", "Standard", "Professional", "Premium", "Pro", "Free", "Enterprise", "Basic")
PRODUCT_PATTERNS = [
    (r"(?iU)\b(" + _TIERS + r")\s+" + T.any_of("trial", "tier", "subscription", "plan", "package", "edition", "account") + r"\b", 1),
    (r"(?iU)\b(Enterprise|Professional|Starter)\s+" + T.any_of("users?", "pricing", "features?", "customers?") + r"\b", 1),
    (r"(?U)\b([A-Z][a-z]+)\b[^.]{0,30}\$\d+(?:\.\d+)?/" + T.any_of("yr", "year", "month", "mo"), 1),
]


def products(chunks: DataFrame, company: str = "", *, content_col: str = "content", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(product): plans, tiers and capitalised words before a price."""
    found = _found(chunks, PRODUCT_PATTERNS, content_col, keys)
    found = found.where((F.col("which") < 2) | (~F.col("found").isin(TITLE_WORDS) & (F.col("found") != company)))
    return found.select(F.when(F.col("which") < 2, F.initcap("found")).otherwise(F.col("found")).alias("product")).where("product <> 'Free'").distinct()


SCOPE_PATTERNS = {
    "region": r"(?iU)\b" + T.any_of("US", "UK", "North America", "Europe", "EU", "EMEA", "Asia", "APAC") + r"\b",
    "tier": r"(?iU)\b" + _TIERS + r"\b",
    "version": r"(?U)\b[Vv](?:ersion)?\s*(\d+(?:\.\d+)*)\b",
}


def scopes(chunks: DataFrame, *, content_col: str = "content", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(type, value): regions, tiers and versions that are named."""
    found = _found(chunks, [(p, int(k == "version")) for k, p in SCOPE_PATTERNS.items()], content_col, keys)
    value = F.when(F.col("which") == 2, F.concat(F.lit("v"), "found")).otherwise(F.initcap("found"))
    return found.select(F.element_at(F.array(*map(F.lit, SCOPE_PATTERNS)), F.col("which") + 1).alias("type"), value.alias("value")).distinct()


_OBJECTS = T.any_of("subscription", "service", "profile", "plan", "membership", "data", "account", "access")
_VERBS = T.any_of("terminate", "revoke", "remove", "disable", "delete", "deactivate", "close", "cancel")
DESTRUCTIVE_PATTERNS = (
    (r"(?iU)\b(" + _VERBS + r")\s+(?:an?\s+|my\s+|the\s+|your\s+)?(" + _OBJECTS + r")\b", 1, 2),
    (r"(?iU)\b(?:to|may|can)\s+(" + T.any_of("terminate", "delete", "deactivate", "close", "cancel") + r")\b[^.]{0,30}\b(" + T.any_of("subscription", "service", "plan", "membership", "account") + r")\b", 1, 2),
    (r"(?iU)\b(request)\s+(?:a\s+)?(" + T.any_of("termination", "deletion", "cancellation") + r")\b", 1, 2),
)


def destructive_phrases(chunks: DataFrame, *, content_col: str = "content", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(phrase, first): verb and object of actions that destroy something."""
    each = ", ".join(f"transform(arrays_zip(regexp_extract_all({content_col}, {T.quote(p)}, {a}), regexp_extract_all({content_col}, {T.quote(p)}, {b})), (x, i) -> struct({k} AS which, i AS pos, lower(concat(x['0'], ' ', x['1'])) AS phrase))" for k, (p, a, b) in enumerate(DESTRUCTIVE_PATTERNS))
    found = structs(chunks, keys, f"concat({each})", "which")
    return found.groupBy("phrase").agg(F.min(F.struct(*keys, "which", "pos")).alias("first"))


def topic_groups(frequencies: DataFrame, *, least: int = 2) -> DataFrame:
    """(stem, anchor, words): frequent words that begin alike in six letters, and the most frequent of them (ties: the first in the alphabet)."""
    rows = frequencies.where((F.col("n") >= least) & (F.length("word") >= 6)).withColumn("stem", F.substring("word", 1, 6))
    return rows.groupBy("stem").agg(F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("anchor"), F.array_sort(F.collect_list("word")).alias("words"))


def anchors(frequencies: dict[str, int], least: int = 2) -> dict[str, list[str]]:
    """Greedy groups of frequent words, in alphabetical order, by six letters in common or one beginning with the other (five letters or more)."""
    groups: dict[str, list[str]] = {}
    stems: dict[str, str] = {}  # beginnings of roots, so that no word is held against all roots
    for w in sorted(k for k, n in frequencies.items() if n >= least):
        found = [stems[w[:6]]] if len(w) >= 6 and w[:6] in stems else []
        found += [w[:n] for n in range(5, len(w) + 1) if w[:n] in groups]
        root = min(found, default=w)
        groups.setdefault(root, []).append(w)
        if root == w and len(w) >= 6:
            stems.setdefault(w[:6], w)
    return {min(ws, key=lambda w: (-frequencies[w], w)): ws for ws in groups.values()}


def infer(chunks: DataFrame, *, title: str = "", content_col: str = "content", keys: tuple[str, ...] = KEYS, least_actor: int = 2, least_word: int = 2, most: int | None = None) -> Context:
    """The context of a corpus, with all of each inventory, which the driver holds. ``most`` bounds what is brought there: the most frequent actors, acronyms and words, the first scopes and products in the alphabet, the first destructive phrases."""

    def cut(df: DataFrame) -> DataFrame:
        return df if most is None else df.limit(most)

    freq = word_frequencies(chunks, content_col=content_col)
    kind = domain_type(domain_scores(freq)).first()
    company = company_of_title(title)
    if not company:
        top = company_candidates(chunks, content_col=content_col, keys=keys).orderBy(F.desc("n"), "first").limit(1).collect()
        company = top[0].name if top and top[0].n >= 3 else ""

    def listed(df: DataFrame, column: str) -> list[str]:
        return [r[0] for r in cut(df.orderBy("first")).select(column).collect()]

    who = cut(actors(chunks, least=least_actor, content_col=content_col, keys=keys).orderBy(F.desc("n"), "first"))
    short = cut(acronyms(chunks, content_col=content_col, keys=keys).orderBy(F.desc("n"), "acronym")).collect()
    scope: dict[str, list[str]] = {}
    for r in cut(scopes(chunks, content_col=content_col, keys=keys).orderBy("type", "value")).collect():
        scope.setdefault(r.type, []).append(r.value)
    words = {r.word: r.n for r in cut(freq.where(F.col("n") >= least_word).orderBy(F.desc("n"), "word")).collect()}
    return Context(
        kind.domain_type, kind.confidence, company, listed(who, "actor"), {r.acronym: r.expansion for r in short},
        sorted(r[0] for r in cut(products(chunks, company, content_col=content_col, keys=keys).orderBy("product")).collect()),
        {k: scope[k] for k in SCOPE_PATTERNS if k in scope}, listed(destructive_phrases(chunks, content_col=content_col, keys=keys), "phrase"), anchors(words, least_word),
    )


def overridden(c: Context, *, domain_type: str = "", company_name: str = "", actors: list[str] = (), acronyms: dict[str, str] | None = None, products: list[str] = (), destructive: list[str] = ()) -> Context:
    """The context with what the user knows better."""
    union = lambda a, b: list(dict.fromkeys([*a, *b]))
    return replace(
        c, domain_type=domain_type or c.domain_type, company_name=company_name or c.company_name, actors=union(c.actors, actors),
        acronyms=c.acronyms | (acronyms or {}), products=union(c.products, products), destructive=union(c.destructive, destructive),
    )


def sampled(chunks: DataFrame, *, most: int = 6000, content_col: str = "content", order: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, part): a preview for a language model of about ``most`` characters: everything if it fits, else 200 characters of each chunk and a share of the rest."""
    total = chunks.agg(F.sum(F.length(content_col)).alias("total"))
    share = f"CAST(200 + floor(length({content_col}) / total * {most}) AS int)"
    return chunks.crossJoin(F.broadcast(total)).select(*order, F.expr(f"IF(total <= {most}, {content_col}, left({content_col}, {share}))").alias("part"))  # one row


def top_by(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
