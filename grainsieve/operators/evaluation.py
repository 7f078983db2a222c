"""Test questions, retrieval before and after processing, and what it says about quality and risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.rows import elements

CORRECT, PARTIAL = 0.80, 0.60
PASS = 0.7
SOURCES = ("topic", "governance", "clarity", "consistency", "user")


def answer(c: str, most: int = 3) -> str:
    """The first sentences of more than 15 characters, else the beginning."""
    good = f"filter(transform({T.sentences(f'trim({c})', False)}, s -> trim(s)), s -> length(s) > 15)"
    return f"IF(size({good}) > 0, array_join(slice({good}, 1, {most}), ' '), left({c}, 200))"


def budgets(recommended: dict[str, int], total: int = 0, include: tuple[str, ...] = SOURCES[:4]) -> dict[str, int]:
    """Questions of each kind: the fixed kinds as recommended, topics what is left of the total."""
    out = {k: recommended.get(k, 0) if k in include else 0 for k in SOURCES[1:4]}
    want = total if total > 0 else sum(recommended.values())
    return {"topic": max(0, want - sum(out.values())) if "topic" in include else 0, **out}


def recommended(chunks: DataFrame, found: DataFrame | None = None, *, fixed_col: str = "clarity_fixed") -> DataFrame:
    """One row: how many questions each kind could have. ``chunks`` has tag, behavior and perhaps remediated and clarity_fixed."""
    flag = lambda c: F.count_if(F.col(c)) if c in chunks.columns else F.lit(0)
    out = chunks.agg(F.count_if(F.col("tag") == "content").alias("topic"), (flag("remediated") + F.count_if(F.col("behavior") == "review")).alias("governance"), flag(fixed_col).alias("clarity"))
    n = found.agg(F.count("*").alias("consistency")) if found is not None else chunks.sparkSession.createDataFrame([(0,)], "consistency long")
    return out.crossJoin(F.broadcast(n)).withColumn("total", F.expr("topic + governance + clarity + consistency"))  # one row


def questions(chunks: DataFrame, found: DataFrame | None, budget: dict[str, int], *, key: str = "chunk", user: DataFrame | None = None) -> DataFrame:
    """Question and expected answer, one a chunk or contradiction and kind, within the budgets; the first of equal questions counts.

    Columns: source, ord, question, expected_answer, behavior, chunk, must_review. ``found`` has a, b, conflict, rationale, decision.
    """
    has = lambda c: F.col(c) if c in chunks.columns else F.lit(False)
    base = chunks.select(F.col(key).alias("chunk"), "heading", F.expr(answer("content")).alias("expected_answer"), "tag", "behavior", has("remediated").alias("remediated"), has("clarity_fixed").alias("fixed"))

    def kind(source: str, rows: DataFrame, ask: str, behavior: str, review: bool, rank: int = 0) -> DataFrame:
        return rows.select(F.lit(source).alias("source"), F.lit(rank).alias("rank"), F.col("chunk").cast("long").alias("chunk"), F.expr(f"concat('{ask}', heading, '?')").alias("question"), "expected_answer", F.lit(behavior).alias("behavior"), F.lit(review).alias("must_review"))

    parts = [
        kind("topic", base.where("tag = 'content'"), "Can you help me with ", "answer", False),
        kind("governance", base.where("remediated"), "What details are available about ", "answer_safe", False),
        kind("governance", base.where("behavior = 'review'"), "What can you tell me about ", "caveat", True, 1),
        kind("clarity", base.where("fixed"), "Can you explain ", "answer", False),
    ]
    if found is not None:
        decision = F.col("decision") if "decision" in found.columns else F.lit(None).cast("string")
        f = found.select("a", "b", "conflict", "rationale", decision.alias("decision"))
        f = f.withColumn("_t", F.lower(F.concat("conflict", F.lit(":"), F.expr("left(rationale, 40)")))).groupBy("_t").agg(F.min(F.struct("a", "b", "decision")).alias("f")).select("f.*")
        side = base.select("chunk", "heading", "expected_answer")
        both = f.join(side.select(F.col("chunk").alias("a"), F.col("heading").alias("ha"), F.col("expected_answer").alias("ea")), "a").join(side.select(F.col("chunk").alias("b"), F.col("heading").alias("hb"), F.col("expected_answer").alias("eb")), "b")
        second = "decision = 'select_b'"
        sure = "coalesce(decision IN ('select_a', 'select_b'), false)"
        parts.append(both.select(
            F.lit("consistency").alias("source"), F.lit(0).alias("rank"), F.expr(f"CAST(IF({second}, b, a) AS bigint)").alias("chunk"), F.expr(f"concat('Can you tell me about ', IF({second}, hb, ha), '?')").alias("question"),
            F.expr(f"IF({sure}, IF({second}, eb, ea), concat('There are two views: (', ha, '): ', left(ea, 120), '. (', hb, '): ', left(eb, 120), '.'))").alias("expected_answer"), F.expr(f"IF({sure}, 'answer', 'caveat')").alias("behavior"), F.lit(True).alias("must_review")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    limit = "CASE " + " ".join(f"WHEN source = '{k}' THEN {n}" for k, n in budget.items()) + " END"
    # one window a kind: its budget is at most as many as the kind has rows, its order is what a budget means
    out = out.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy("rank", "chunk", "question"))).where(F.expr(f"ord <= {limit}"))
    if user is not None:
        out = out.unionByName(user.select(F.lit("user").alias("source"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("chunk"), "question", F.coalesce("expected_answer", F.lit("")).alias("expected_answer"), F.coalesce("behavior", F.lit("answer")).alias("behavior"), F.lit(False).alias("must_review"), F.xxhash64("question").cast("int").alias("ord")))
    place = F.struct(F.expr("CASE " + " ".join(f"WHEN source = '{s}' THEN {i}" for i, s in enumerate(SOURCES)) + " END").alias("s"), F.col("ord"))
    out = out.where(F.trim("question") != "").withColumn("_p", place)
    first = out.groupBy(F.lower(F.trim("question")).alias("_q")).agg(F.min_by(F.struct(*[c for c in out.columns if c not in ("_p", "rank")]), "_p").alias("r"))
    return first.select("r.*")


def coverage(asked: DataFrame) -> DataFrame:
    """Questions and chunks by source and behaviour, with totals."""
    return asked.rollup("source", "behavior").agg(F.count("*").alias("questions"), F.countDistinct("chunk").alias("chunks"))


#: Characters that a block of texts has at most, and rows of it: questions, chunks.
BLOCK_CHARS, BLOCK_QUESTIONS, BLOCK_CHUNKS = 1 << 20, 2048, 512


def _word_blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows of a key and its words, divided by blanks, many to a row: keys in order, numbers of words, and (row, word, times) of each different word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(size):
                stop = min(max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_CHARS, "right"))), at + most)
                block = batch.slice(at, stop - at)
                block = block.take(pc.sort_indices(block.column(0), null_placement="at_start"))
                each = [Counter((t.as_py() or "").split()) for t in block.column(1)]
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), block.column(0)), one([n.total() for n in each], pa.int64()), one(np.repeat(np.arange(len(each)), [len(n) for n in each]), pa.int64()), one([w for n in each for w in n], pa.string()), one([f for n in each for f in n.values()], pa.int64())], names=["keys", "lengths", "at", "words", "times"])
                at = stop

    return rows.mapInArrow(run, f"keys array<{rows.schema[0].dataType.simpleString()}>, lengths array<bigint>, at array<bigint>, words array<string>, times array<bigint>")


def bm25(asked: DataFrame, chunks: DataFrame, *, question_id: str = "question_id", question_col: str = "question", key: str = "chunk", content_col: str = "content", k: int = 3, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(question_id, chunk, score, rank): the k best chunks of each question by term saturation, without inverse document frequency.

    A chunk is only scored for questions it shares a word with; a question with fewer such chunks has fewer rows. Ties go to
    the smaller key. Blocks of questions meet blocks of chunks and the k best of each are passed on, so that neither words nor
    scores are shuffled. Rows of one key are one chunk; where keys repeat, their words alone are joined as postings.
    """
    terms = elements(asked, (question_id,), f"array_distinct({T.words(question_col, 2)})", "term").distinct()
    counted = chunks.select(key, F.expr(T.words(content_col, 2)).alias("w"))
    mean = counted.agg(F.greatest(F.avg(F.size("w")), F.lit(1.0)).alias("avgdl"))  # one row
    repeated = F.broadcast(chunks.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k"))  # ids, as a rule none
    same = F.col(key).eqNullSafe(F.col("_k"))
    q = _word_blocks(terms.groupBy(F.col(question_id).alias("key")).agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("w")).repartition(1), BLOCK_QUESTIONS)
    c = _word_blocks(chunks.join(repeated, same, "left_anti").select(F.col(key).alias("key"), F.expr(f"array_join({T.words(content_col, 2)}, ' ')").alias("w")), BLOCK_CHUNKS)
    kinds = [x.schema["keys"].dataType.elementType for x in (q, c)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ck, cl, ca, cw, cf, qk, _, qa, qw, _ = (batch.column(o)[n].values for o in range(10))
                number = {w: i for i, w in enumerate(sorted(set(qw.to_pylist())))}
                term = np.fromiter((number.get(w, -1) for w in cw.to_pylist()), np.int64, len(cw))
                hit = np.flatnonzero(term >= 0)
                hit = hit[np.lexsort((term[hit], ca.to_numpy()[hit]))]  # terms are added in one order everywhere
                at, f = ca.to_numpy()[hit], cf.to_numpy()[hit].astype(float)
                part = f * (k1 + 1) / (f + k1 * ((1 - b) + b * cl.to_numpy()[at] / batch.column(10)[n].as_py()))
                # the questions of each term, one behind the other
                of = np.fromiter((number[w] for w in qw.to_pylist()), np.int64, len(qw))
                order = np.argsort(of, kind="stable")
                asks, first = qa.to_numpy()[order], np.searchsorted(of[order], np.arange(len(number) + 1))
                many = (first[1:] - first[:-1])[term[hit]]
                each = np.repeat(first[term[hit]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                s = np.bincount(asks[each] * len(ck) + np.repeat(at, many), np.repeat(part, many), len(qk) * len(ck)).reshape(len(qk), len(ck))
                s = np.where(s > 0, s, -np.inf)
                i, j, level = _best_of_block(s, k, lambda x, y: float(s[x, y]))
                some = level != _VOID
                yield pa.RecordBatch.from_arrays([qk.take(pa.array(i[some])), ck.take(pa.array(j[some])), pa.array(level[some] / 1e6)], names=["q", "c", "score"])

    names = ["keys", "lengths", "at", "words", "times"]
    pairs = c.toDF(*(f"c{x}" for x in names)).crossJoin(q.toDF(*(f"q{x}" for x in names))).crossJoin(F.broadcast(mean))
    out = pairs.mapInArrow(run, f"q {kinds[0].simpleString()}, c {kinds[1].simpleString()}, score double").select(F.col("q").alias(question_id), F.col("c").alias(key), "score")
    again = chunks.join(repeated, same, "left_semi").select(key, F.expr(T.words(content_col, 2)).alias("w")).select(key, "w", F.size("w").alias("dl"))
    postings = elements(again, (key, "dl"), "w", "term").groupBy(key, "dl", "term").agg(F.count("*").alias("f"))
    part = f"f * {k1 + 1}D / (f + {k1}D * ({1 - b}D + {b}D * dl / avgdl))"
    scores = terms.join(postings, "term").crossJoin(F.broadcast(mean)).groupBy(question_id, key).agg(F.round(F.sum(F.expr(part)), 6).alias("score"))
    return _best(out.unionByName(scores), question_id, key, k)


#: Values and rows that a block of vectors has at most.
BLOCK_VALUES, BLOCK_ROWS = 1 << 18, 4096
_VOID, _NAN = -(1 << 62), 1 << 62  # levels of null and NaN, which come last and first


def _blocks(df: DataFrame, key: str, vector_col: str) -> DataFrame:
    """Rows with a vector, many to a row and each partition in the order of ``key``: keys, lengths (-1 - length where an element is null), values, norms."""
    rows = df.where(F.col(vector_col).isNotNull()).select(F.col(key).alias("key"), F.expr(f"transform({vector_col}, x -> CAST(x AS double))").alias("v")).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, v = batch.column(0), batch.column(1)
            sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = v.flatten(), np.cumsum(sizes)
            void = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(sizes):
                start = int(ends[at] - sizes[at])
                stop = min(max(at + 1, int(np.searchsorted(ends, start + BLOCK_VALUES, "right"))), at + BLOCK_ROWS)
                size, x = sizes[at:stop], values[start : int(ends[stop - 1])]
                has_null = void[ends[at:stop]] > void[ends[at:stop] - size]
                norms = np.ones(len(size))
                for d in np.unique(size):
                    own = np.flatnonzero((size == d) & ~has_null)
                    norms[own] = np.sqrt(_in_order(m := _matrix(x, size, own), m))
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays([one(keys.slice(at, stop - at)), one(pa.array(np.where(has_null, -1 - size, size))), pa.array([x.tobytes()], pa.binary()), one(pa.array(norms))], names=["keys", "sizes", "v", "norms"])
                at = stop

    return rows.mapInArrow(run, f"keys array<{rows.schema[0].dataType.simpleString()}>, sizes array<bigint>, v binary, norms array<double>")


def _matrix(values: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Vectors of one size among those that lie one behind the other."""
    d = int(sizes[rows[0]]) if len(rows) else 0
    if len(rows) == len(sizes):
        return values.reshape(len(rows), d)
    return values[(np.cumsum(sizes) - sizes)[rows][:, None] + np.arange(d)]


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first element on, so that the last bit is always the same."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _nearest(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each question of a block the k best of a block of chunks: question, chunk, score in millionths."""
    (qs, qv, qn), (cs, cv, cn) = q, c
    s = np.full((len(qs), len(cs)), -np.inf)
    held = {}
    with np.errstate(all="ignore"):
        for d in np.intersect1d(qs[qs >= 0], cs[cs >= 0]):
            i, j = np.flatnonzero(qs == d), np.flatnonzero(cs == d)
            x, y = _matrix(qv, np.where(qs < 0, -1 - qs, qs), i), _matrix(cv, np.where(cs < 0, -1 - cs, cs), j)
            near = (x / qn[i, None]) @ (y / cn[j, None]).T
            held[int(d)] = (i, j, x, y)
            if near.shape == s.shape:
                s = near
            else:
                s[np.ix_(i, j)] = near
    s[qn == 0] = 0
    s[:, cn == 0] = 0
    if np.isnan(s.sum()):
        s[np.isnan(s)] = np.inf

    def again(r: int, j: int) -> float:
        gi, gj, x, y = held[int(qs[r])]
        return float(_in_order(x[np.searchsorted(gi, r)][None], y[np.searchsorted(gj, j)][None])[0] / (qn[r] * cn[j]))

    return _best_of_block(s, k, again)


def _best_of_block(s: np.ndarray, k: int, again: Callable[[int, int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row of scores, by the rounded score and then the place: row, column, score in millionths; ``again`` is asked next to a border between two roundings."""
    least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
    r, j = np.nonzero(s >= least[:, None] - 2e-6)  # all that may round to the k best
    v = s[r, j]
    far = np.where(np.isfinite(v), np.abs(v) * 1e6, 0)
    level = np.where(np.isfinite(v), np.sign(v) * np.floor(far + 0.5), 0).astype(np.int64)
    level[v == np.inf], level[v == -np.inf] = _NAN, _VOID
    for at in np.flatnonzero(np.abs(far - np.floor(far) - 0.5) < 1e-3):
        level[at] = int(Decimal(repr(again(r[at], j[at]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    order = np.lexsort((j, -level, r))
    r, j, level = r[order], j[order], level[order]
    kept = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[kept], j[kept], level[kept]


def cosine(asked: DataFrame, chunks: DataFrame, *, question_id: str = "question_id", key: str = "chunk", vector_col: str = "embedding", k: int = 3) -> DataFrame:
    """(question_id, chunk, score, rank): the k best chunks by cosine of all with a vector; exact, every question against every chunk.

    Blocks of questions meet blocks of chunks as products of matrices; a task holds one of each and passes on the k best. Vectors
    of different lengths, or with a null in them, have no score and come last; a vector of zeros has 0.
    """
    q, c = _blocks(asked, question_id, vector_col), _blocks(chunks, key, vector_col)
    kinds = [x.schema["keys"].dataType.elementType for x in (q, c)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                sides = [(batch.column(o + 1)[n].values.to_numpy(), np.frombuffer(batch.column(o + 2)[n].as_buffer()), batch.column(o + 3)[n].values.to_numpy()) for o in (0, 4)]
                i, j, level = _nearest(*sides, k)
                score = np.where(level == _NAN, np.nan, level / 1e6)
                yield pa.RecordBatch.from_arrays([batch.column(0)[n].values.take(pa.array(i)), batch.column(4)[n].values.take(pa.array(j)), pa.array(score, mask=level == _VOID)], names=["q", "c", "score"])

    # every task reads all questions and its share of chunks; the blocks are shuffled, so that they are made once
    tasks = 2 * chunks.sparkSession.sparkContext.defaultParallelism
    pairs = q.repartition(1).toDF("qk", "qs", "qv", "qn").crossJoin(c.repartition(tasks).toDF("ck", "cs", "cv", "cn"))
    out = pairs.mapInArrow(run, f"q {kinds[0].simpleString()}, c {kinds[1].simpleString()}, score double")
    return _best(out.select(F.col("q").alias(question_id), F.col("c").alias(key), "score"), question_id, key, k)


def _best(scores: DataFrame, question_id: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(question_id).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def overlap(expected: str, retrieved: str) -> str:
    """Share of the expected words that were retrieved; 1 if none are expected."""
    e = f"array_distinct({T.words(expected, 2)})"
    return f"IF(size({e}) = 0, 1D, size(array_intersect({e}, {T.words(retrieved, 2)})) / size({e}))"


def judged(pairs: DataFrame, *, correct: float = CORRECT, partial: float = PARTIAL, compat: bool = False, similarity: str | None = None) -> DataFrame:
    """``pairs`` (question with expected_answer, behavior and retrieved, null if nothing was) with ``similarity`` and ``verdict``.

    What should be blocked is correct when nothing came back; with ``compat`` it never is. ``similarity`` is an expression to use in place of the overlap of words, as that of embeddings.
    """
    out = pairs.withColumn("similarity", F.expr(similarity or overlap("expected_answer", "retrieved")))
    blocked = "'incorrect'" if compat else "IF(retrieved IS NULL, 'correct', 'incorrect')"
    return out.withColumn("verdict", F.expr(f"CASE WHEN behavior = 'block' THEN {blocked} WHEN retrieved IS NULL THEN 'incorrect' WHEN similarity >= {correct} THEN 'correct' WHEN similarity >= {partial} THEN 'partial' ELSE 'incorrect' END"))


def points(verdict: str) -> str:
    return f"CASE {verdict} WHEN 'correct' THEN 1D WHEN 'partial' THEN 0.5D ELSE 0D END"


def metrics(results: DataFrame, *, threshold: float = PASS, tolerance: float = 0.1, before: str = "verdict_before", after: str = "verdict_after", by: tuple[str, ...] = ()) -> DataFrame:
    """Recall, accuracy, safety, hallucination and risk before and after, over all questions or by some columns."""
    aggs = [F.count("*").alias("total")]
    for side, v in (("before", before), ("after", after)):
        p = F.expr(points(v))
        ok = F.count_if(p >= threshold)
        safe = F.col("behavior") == "answer_safe"
        caveat = F.col("behavior") == "caveat"
        failing = (F.count("*") - ok) / F.count("*")
        risk = F.when(ok == F.count("*"), 0.0).otherwise(100.0) if tolerance <= 0 else F.least(F.lit(100.0), failing / tolerance * 50.0)
        aggs += [
            (ok / F.count("*")).alias(f"recall_{side}"), F.avg(p).alias(f"accuracy_{side}"), F.try_divide(F.count_if(safe & (p >= threshold)), F.count_if(safe)).alias(f"safety_{side}"),
            F.try_divide(F.count_if(caveat & (p == 0)), F.count_if(caveat)).alias(f"hallucination_{side}"), risk.alias(f"risk_{side}"),
        ]
    return (results.groupBy(*by) if by else results.groupBy()).agg(*aggs)


def compared(results: DataFrame, *, score: str = "score", pool: str = "pool", by: str = "category") -> DataFrame:
    """Mean score of each category for the pools baseline and processed, and the difference."""
    mean = lambda p: F.avg(F.when(F.col(pool) == p, F.col(score)))
    return results.groupBy(by).agg(mean("baseline").alias("baseline"), mean("processed").alias("processed")).withColumn("delta", F.expr("processed - baseline"))


def module_issues(stats: DataFrame) -> DataFrame:
    """Detected, resolved on its own, and left for a person, by module (module_id, detected, resolved, confirmed)."""
    return stats.select("module_id", "detected", F.col("resolved").alias("auto"), F.coalesce("confirmed", F.lit(0)).cast("long").alias("user"), F.expr("CAST(greatest(0, detected - resolved - coalesce(confirmed, 0)) AS bigint)").alias("pending"))


def token_accounting(changes: DataFrame) -> DataFrame:
    """Words added and removed by kind and reason (change_type, reason, token_count), with totals."""
    return changes.rollup("change_type", "reason").agg(F.sum("token_count").alias("tokens"), F.count("*").alias("changes"))
