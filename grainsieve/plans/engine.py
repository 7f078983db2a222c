"""From documents to a cleaned, re-chunked, checked knowledge base, and its evaluation.

Every phase is a DataFrame; between phases tables are written in the shared folder, so that what
follows doesn't compute them again and lost executors cost little.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.rows import structs
from grainsieve.operators import chunking, clarity, consistency, domain, evaluation, governance, models, structure, tables, temporal
from grainsieve.operators.domain import Context
from grainsieve.sources.files import embed, from_any

#: Chunks of which a model sees something to infer the context.
PREVIEW = 200


@dataclass
class Config:
    """What a run can be told. ``today`` is an ISO date; ``phases`` any of 1 (intake), 2 (dates) and 3 (detection and repair).

    ``model`` (text to text) and ``embedder`` (texts to vectors) run on the executors and must be picklable. With a model,
    headings, summaries of tables, figures and procedures, clarity, governance and contradictions go by it; ``domain_mode``
    says whether the context is by ``rules``, by both (``hybrid``) or by the ``model``. ``judge`` is ``similarity``, ``model`` or
    ``similarity_then_model``. ``detection_confidence`` is accepted and has no effect.
    """

    least_words: int = chunking.MIN_WORDS
    most_words: int = chunking.MAX_WORDS
    topic_shift: float = chunking.SHIFT
    pii_mode: str = "smart"
    detectors_off: tuple[str, ...] = ()
    tag_behavior: dict[str, str] = field(default_factory=dict)
    custom_rules: list[dict[str, str]] = field(default_factory=list)
    detection_confidence: str = "medium"
    freshness_days: int = temporal.STALE_DAYS
    priority_authors: tuple[str, ...] = ()
    scope_filters: dict[str, list[str]] = field(default_factory=dict)
    resolve_from: float = 0.7
    domain_type: str = ""
    company_name: str = ""
    extra_actors: tuple[str, ...] = ()
    extra_acronyms: dict[str, str] = field(default_factory=dict)
    extra_products: tuple[str, ...] = ()
    extra_destructive: tuple[str, ...] = ()
    total_questions: int = 0
    today: str = "2026-01-01"
    phases: tuple[int, ...] = (1, 2, 3)
    model: Callable[[str], str] | None = None
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    domain_mode: str = "rules"
    judge: str = "similarity"


@dataclass
class Result:
    chunks: DataFrame
    raw_chunks: DataFrame
    context: Context
    findings: dict[str, DataFrame]
    stats: DataFrame
    #: (module_id, name, value): what else a module counted
    measures: DataFrame
    #: (module_id, change_type, reason, token_count): words that a module added to or removed from a chunk or document
    changes: DataFrame


def _folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _folder.own = getattr(_folder, "own", None) or tempfile.mkdtemp(prefix="grainsieve-")
        path = f"file://{_folder.own}"
    return path.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    spark, path = df.sparkSession, f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_numbers(docs: DataFrame) -> DataFrame:
    """Documents with a dense number each, ``doc_no``; equal ids stay different documents."""
    marked = kept(docs.withColumn("_m", F.monotonically_increasing_id()), "docs")
    sizes = marked.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("n")).orderBy("_p").collect()  # a row for each partition
    start, rows = 0, []
    for r in sizes:
        rows.append((r._p, start))
        start += r.n
    offsets = docs.sparkSession.createDataFrame(rows, "_p long, _o long")
    return marked.join(F.broadcast(offsets), F.shiftright("_m", 33) == F.col("_p")).withColumn("doc_no", F.expr("_o + (_m & 8589934591L)")).drop("_m", "_p", "_o")


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with a number over all documents: neighbours in a document differ by one, those of different documents by more than what counts as near."""
    return chunks.withColumn("chunk", F.col("doc_no") * (1 << 20) + F.col("chunk_no"))


def analyze(spark: SparkSession, data, config: Config | None = None) -> Result:
    """The whole run over documents in any form that ``from_any`` takes."""
    c = config or Config()
    docs = kept(with_numbers(from_any(spark, data)), "numbered")
    raw = kept(chunking.raw_chunks(docs, id_col="doc_no", least=c.least_words, most=c.most_words), "raw")
    one = docs.limit(2).collect()
    ctx = domain.infer(raw, title=one[0].title if len(one) == 1 else "", keys=("doc_no", "chunk_no"))
    if c.model and c.domain_mode in ("hybrid", "model"):
        ctx = models.inferred(ctx, [r.part for r in domain.sampled(raw, order=("doc_no", "chunk_no")).orderBy("doc_no", "chunk_no").limit(PREVIEW).collect()], c.model, only=c.domain_mode == "model")
    ctx = domain.overridden(ctx, domain_type=c.domain_type, company_name=c.company_name, actors=c.extra_actors, acronyms=c.extra_acronyms, products=c.extra_products, destructive=c.extra_destructive)
    ctx.scopes |= c.scope_filters
    ctx.acronyms = {k: v for k, v in ctx.acronyms.items() if v}
    found: dict[str, DataFrame] = {}
    stats: list[DataFrame] = []

    def count(module: str, df: DataFrame, detected, resolved) -> None:
        stats.append(df.agg(F.lit(module).alias("module_id"), F.coalesce(detected, F.lit(0)).cast("long").alias("detected"), F.coalesce(resolved, F.lit(0)).cast("long").alias("resolved")))

    pages = docs.select("doc_no", F.col("text").alias("html"))
    parts = {"table": tables.tables(pages, id_col="doc_no"), "figure": tables.figures(pages, id_col="doc_no"), "procedure": tables.procedures(pages, id_col="doc_no")}
    if c.model:
        parts = {k: models.described(v, k, c.model) for k, v in parts.items()}
    parts = {k: kept(v, k) for k, v in parts.items()}
    found["A12"] = tables.extracted(parts)
    count("A12", found["A12"], F.count("*"), F.count_if(~F.col("is_gap")))
    measures: list[DataFrame] = []
    changes: list[DataFrame] = []

    def measure(module: str, row: DataFrame) -> None:
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("value")) for n in row.columns])).alias("m")
        measures.append(row.select(pairs).select(F.lit(module).alias("module_id"), "m.name", "m.value"))

    def changed(module: str, rows: DataFrame, kind: str, reason: str, tokens: str) -> None:
        changes.append(rows.select(F.lit(module).alias("module_id"), F.lit(kind).alias("change_type"), F.expr(reason).alias("reason"), F.expr(f"CAST({tokens} AS bigint)").alias("token_count")).where("token_count > 0"))

    changed("A12", found["A12"], "added", "kind", "words_added")
    html = tables.normalized(pages, id_col="doc_no", parts=parts)
    named = structure.named_sections(html, id_col="doc_no")
    named = kept(models.headings(named, c.model) if c.model else named, "sections")
    found["A13"] = named.where("heading_source <> 'original'")
    count("A13", named, F.count_if(F.expr(f"words >= {structure.LEAST_WORDS} AND (is_orphan OR is_generic)")), F.count_if(F.col("heading_source") != "original"))
    measure("A13", structure.summary(named).select("words_in", "words_out"))
    changed("A13", found["A13"], "added", "'heading'", T.word_count("new_heading"))
    whole = named.groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("section_no", F.col("new_heading").alias("heading"), "content"))).alias("sections"))
    chunks = chunking.smart_chunks(whole, id_col="doc_no", least=c.least_words, most=c.most_words, threshold=c.topic_shift)
    meta = docs.select("doc_no", "doc_id", "title", F.expr("metadata['last_modified']").alias("last_modified"), F.expr("metadata['author']").alias("author"))
    chunks = kept(numbered(chunks.join(meta, "doc_no")).withColumn("tag", F.lit("content")).withColumn("tag_reason", F.lit("")), "chunks")
    if 2 in c.phases:
        chunks = kept(temporal.flag_stale(temporal.enrich(chunks, c.today, stale_days=c.freshness_days)), "dated")
        count("A22", chunks, F.count_if("is_stale"), F.lit(0))
        measure("A22", temporal.summary(chunks))
    if 3 in c.phases:
        chunks = clarity.with_findings(chunks, ctx)
        if c.model:
            chunks = models.rewritten_sentences(kept(models.resolved_terms(chunks, ctx, c.model), "resolved"), c.model)
        chunks = kept(chunks, "clarity")
        found["A30"] = chunks.select("doc_id", "chunk_no", "chunk", F.explode("clarity").alias("f")).select("doc_id", "chunk_no", "chunk", "f.*")
        chunks = kept(clarity.fix(chunks.withColumn("_before", F.expr(T.word_count("content"))), ctx), "clear").drop("clarity")
        changed("A30", chunks.where("clarity_fixed"), "added", "'clarity'", "words - _before")
        changed("A30", chunks.where("clarity_fixed"), "removed", "'clarity'", "_before - words")
        chunks = chunks.drop("_before")
        count("A30", found["A30"], F.count("*"), F.count_if(F.expr("confident AND proposal <> ''")))
        chunks = kept(governance.with_findings(chunks, governance.detectors(c.pii_mode, off=c.detectors_off)), "found")
        if "destructive" not in c.detectors_off:
            phrases = spark.createDataFrame([(p,) for p in ctx.destructive], "phrase string")
            found["A31_domain"] = kept(governance.destructive_in_domain(chunks, phrases, id_cols=("doc_id", "chunk_no", "chunk")), "destructive")
            chunks = governance.with_more(chunks, found["A31_domain"])
        if c.model:
            chunks = models.validated(chunks, c.model)
        chunks = kept(chunks, "judged")
        found["A31"] = structs(chunks, ("doc_id", "chunk_no", "chunk"), "findings", "detector")
        if c.model:
            chunks = models.remediated(chunks, c.model, domain=ctx.domain_type)
        chunks = kept(governance.custom_rules(governance.clean(chunks), c.custom_rules), "clean").drop("findings")
        changed("A31", chunks.where("changed"), "removed", "IF(content = '', 'whole chunk', 'sentences')", "words_before - words")
        measure("A31", chunks.agg(F.count_if("changed").alias("chunks_cleaned"), F.count_if(F.expr("changed AND content = ''")).alias("chunks_removed")))
        fixed = "changed OR remediated" if "remediated" in chunks.columns else "changed"
        stats.append(found["A31"].agg(F.lit("A31").alias("module_id"), F.count("*").alias("detected")).crossJoin(F.broadcast(chunks.agg(F.count_if(F.expr(f"coalesce({fixed}, false)")).alias("resolved")))))  # one row each
        ready = kept(consistency.prepared(chunks, ctx.actors, ctx.scopes), "prepared")
        compared = kept(consistency.candidate_pairs(ready), "compared")
        measure("A32", compared.agg(F.count("*").alias("pairs_evaluated")).crossJoin(F.broadcast(ready.agg(F.count("*").alias("total_chunks")))))  # one row each
        conflicts = consistency.conflicts(ready, compared)
        scored = consistency.scored(conflicts, ready, priority_authors=list(c.priority_authors))
        found["A32"] = kept(models.judged_conflicts(scored, c.model, domain=ctx.domain_type) if c.model else scored, "conflicts")
        chunks = kept(consistency.resolve(ready, found["A32"], threshold=c.resolve_from), "resolved")
        count("A32", found["A32"], F.count("*"), F.count_if(F.expr(f"score >= {c.resolve_from} AND winner <> ''")))
        both = chunks.select("chunk", "auto_resolved", F.expr(T.word_count("content")).alias("_now")).join(ready.select("chunk", F.expr(T.word_count("content")).alias("_before")), "chunk")
        changed("A32", both.where("auto_resolved"), "removed", "'contradiction'", "_before - _now")
        resolved, chunks = chunks, rechunked(chunks, c)
        found["A32"] = kept(carried(found["A32"], resolved, chunks), "carried")
    out = governance.behavior(chunks, c.tag_behavior)
    joined = lambda parts: reduce(DataFrame.unionByName, parts)
    return Result(kept(out, "final"), raw, ctx, found, joined(stats), joined(measures), joined(changes))


def rechunked(chunks: DataFrame, c: Config) -> DataFrame:
    """Chunks of ten words or more, cut and merged again in their document, behind a prefix of heading and topic words; a chunk has the tag of highest precedence of the headings it is made of."""
    rows = chunks.where(F.expr(f"{T.word_count('content')} >= 10"))
    whole = rows.groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "heading", "content"))).alias("sections"))
    new = numbered(chunking.smart_chunks(whole, id_col="doc_no", least=c.least_words, most=c.most_words, threshold=c.topic_shift))
    base = F.regexp_replace("heading", r"\s*-\s*\d+$", "")
    order = F.struct(F.expr(governance.priority_of("tag")), F.when(F.col("tag") == "content", 1).otherwise(0))
    flag = lambda name: F.max(name) if name in rows.columns else F.max(F.lit(False))
    tags = rows.groupBy("doc_no", base.alias("_h")).agg(F.min_by("tag", order).alias("tag"), F.min_by("tag_reason", order).alias("tag_reason"), flag("clarity_fixed").alias("clarity_fixed"), flag("remediated").alias("remediated"))
    per_doc = rows.groupBy("doc_no").agg(F.first("doc_id").alias("doc_id"), F.first("title").alias("title"), F.first("last_modified").alias("last_modified"), F.first("author").alias("author"))
    new = new.withColumn("_h", base).join(tags, ["doc_no", "_h"], "left").join(per_doc, "doc_no").drop("_h")
    new = kept(new.withColumn("tag", F.coalesce("tag", F.lit("content"))).withColumn("clarity_fixed", F.coalesce("clarity_fixed", F.lit(False))).withColumn("remediated", F.coalesce("remediated", F.lit(False))), "rechunked")
    top = consistency.content_words(new, key="chunk").groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("top"))
    return chunking.enriched(new, top, keys=("chunk",))


def carried(found: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Contradictions with ``chunk_a`` and ``chunk_b``, the re-chunked chunk of the document that holds each side: that with its evidence, else with its heading, else with most of its words; null where the document has none left."""
    base = F.regexp_replace("heading", r"\s*-\s*\d+$", "")
    words = F.expr(f"array_distinct({T.words('content', 2)})")
    had = old.select(F.col("chunk").alias("_old"), "doc_no", base.alias("_h"), words.alias("_w"))
    has = new.select("doc_no", F.col("chunk").alias("_new"), base.alias("_g"), F.lower("content").alias("_c"), words.alias("_v"))
    out = found
    for side in ("a", "b"):
        said = found.select("a", "b", F.col(side).alias("_old"), F.expr(f"lower(left(evidence_{side}, 60))").alias("_e"))
        fit = F.struct(F.expr("contains(_c, _e)"), F.expr("_h = _g"), F.expr("size(array_intersect(_w, _v))"), F.expr("-_new"))
        best = said.join(had, "_old").join(has, "doc_no").groupBy("a", "b").agg(F.max_by("_new", fit).alias(f"chunk_{side}"))
        out = out.join(best, ["a", "b"], "left")
    return out


def evaluate(result: Result, config: Config | None = None, *, user: DataFrame | None = None, tolerance: float = 0.1) -> dict[str, DataFrame]:
    """Questions, what raw and final chunks answer to them, and metrics: pairs, metrics, by_source, coverage."""
    c = config or Config()
    chunks = kept(result.chunks, "pool")
    advice = evaluation.recommended(chunks, result.findings.get("A32")).first().asDict()
    advice.pop("total")
    found = result.findings.get("A32")
    if found is not None:
        found = found.where("chunk_a IS NOT NULL AND chunk_b IS NOT NULL").withColumn("a", F.col("chunk_a")).withColumn("b", F.col("chunk_b"))
    asked = evaluation.questions(chunks, found, evaluation.budgets(advice, c.total_questions), user=user).withColumn("question_id", F.xxhash64("question"))
    if c.embedder:
        asked = embed(embed(asked, "question", "embedding", c.embedder), "expected_answer", "answer_vector", c.embedder)
    asked = kept(asked, "questions")
    served = chunks.where("behavior <> 'block'")
    raw = numbered(result.raw_chunks)
    pairs = asked
    for side, pool in (("before", raw), ("after", served)):
        texts = pool.select("chunk", F.col("content").alias("retrieved"))
        if c.embedder:
            texts = kept(embed(texts, "retrieved", "embedding", c.embedder), "vectors")
            best = evaluation.cosine(asked, texts, k=1)
        else:
            best = evaluation.bm25(asked, pool, k=1)
        both = asked.drop("embedding").join(best.join(texts, "chunk").drop("chunk", "score", "rank"), "question_id", "left")
        judged = evaluation.judged(both, similarity=models.by_vectors(both, "answer_vector", "embedding") if c.embedder else None)
        if c.model and c.judge != "similarity":
            judged = models.verdicts(kept(judged, "judged"), c.model, unclear_only=c.judge == "similarity_then_model")
        pairs = pairs.join(judged.select("question_id", F.col("verdict").alias(f"verdict_{side}")), "question_id")
    pairs = kept(pairs.drop("embedding", "answer_vector"), "pairs")
    return {"pairs": pairs, "metrics": evaluation.metrics(pairs, tolerance=tolerance), "by_source": evaluation.metrics(pairs, tolerance=tolerance, by=("source",)), "coverage": evaluation.coverage(asked)}


def totals(stats: DataFrame) -> DataFrame:
    """Counters over all modules, with a row for each."""
    return stats.rollup("module_id").agg(F.sum("detected").alias("detected"), F.sum("resolved").alias("resolved"))



def issues(result: Result, confirmed: dict[str, int] | None = None) -> DataFrame:
    """By module: what was detected, resolved on its own, settled by a person (``confirmed``, by module) and is left."""
    settled = F.create_map(*[F.lit(x) for kv in (confirmed or {"": 0}).items() for x in kv])
    return evaluation.module_issues(result.stats.withColumn("confirmed", F.try_element_at(settled, F.col("module_id"))))
