"""Near duplicates by n-gram Jaccard with Bayesian candidate pruning (operator 4).

A document's set is its distinct runs of ``n`` words; one of fewer words has a single element,
all its words, and one without words has none and is like no other. Documents with equal sets
form a class, of which the smallest id stands for all. Bands of MinHash values propose buckets.
In a bucket, MinHash values are compared in steps: a pair is dropped as soon as, given the
agreements so far and a uniform prior, the probability that its Jaccard similarity reaches the
threshold is below the tolerance. What is left is verified on the full sets.

``similar_pairs`` compares every pair of a bucket. ``near_duplicates`` needs groups only (connected
components of the verified pairs) and gets the same ones in two rounds. In the first, a document
of a bucket is compared with the bucket's leaders, becoming one unless it is very probably
similar to one already. In the second, all pairs of a bucket are compared whose documents the
verified pairs of the first have not joined. Large groups are joined in the first, so that they
stay linear, and no bucket, group or list of partners has a cap.

A bucket of more than ``bucket_rows`` documents is split. In the first round each part has leaders of its own; then
one document of each group that this leaves in the bucket stands for it, and these are joined in the same way,
again and again while groups get fewer. In the second round the documents of a bucket's largest group are dealt
to its parts, each of which has all the others: only those are held by every task of the bucket.

Ids that are null take no part; ids may be of any type, and the smallest of a group is so in their own order.
Rows that repeat an id count as one document. Null, empty and wordless texts are in no group, texts are
read whole, however long, and an empty table gives an empty result. Only the id and text columns are
read, whatever the names of others.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.graph import components
from grainsieve.llm.ids import Ids
from grainsieve.llm.store import written
from grainsieve.llm.words import SQL_SEPARATOR, Block, blocks, mix, signed

N = 3
THRESHOLD = 0.6
BANDS, ROWS = 21, 3
STEP = 16
TOLERANCE = 0.001
SURE = 0.9
LEAD_ROWS = 1 << 14
BUCKET_ROWS = 1 << 15

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(b: Block, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, end to end, and where each document's begin."""
    h, at = b.grams(n)
    own = b.owner[at]
    size = np.diff(b.first)
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        whole = np.array([mix(np.array([sum(int(c) * (2 * k + 3) for k, c in enumerate(b.code[b.first[d] : b.first[d + 1]])) + int(size[d]) & (1 << 64) - 1], np.uint64))[0] for d in few], np.uint64)
        h, own = np.concatenate([h, whole]), np.concatenate([own, few])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(b.hi - b.lo + 1))


def minhashes(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """One row of 32-bit MinHash values for each document of a non-empty set."""
    out = np.empty((len(head), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), head)
    return out


def sketch(batches: Iterator[pa.RecordBatch], n: int = N) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column(1)):
            h, head = shingle_sets(b, n)
            full = np.flatnonzero(np.diff(head) > 0)
            if not len(full):
                continue
            m = minhashes(h, head[full])
            with np.errstate(over="ignore"):
                same = mix(np.add.reduceat(mix(h), head[full]) + np.diff(head)[full].astype(np.uint64))
                band = m.reshape(len(full), BANDS, ROWS).astype(np.uint64)
                key = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + band[:, :, r])
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BANDS * ROWS), len(full), [None, pa.py_buffer(np.ascontiguousarray(m.astype(np.uint16)))]).cast(pa.binary())
            keys = pa.ListArray.from_arrays(np.arange(0, key.size + 1, BANDS, dtype=np.int32), pa.array(signed(key.reshape(-1))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(b.lo + full)), pa.array(signed(same)), sig, keys], names=["id", "same", "sig", "keys"])


def reach(m: int, n: int, t: float) -> float:
    """Probability of a similarity of at least t after m agreements of n, from a uniform prior."""
    return sum(comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))


def limits(t: float, tolerance: float) -> list[tuple[int, int]]:
    """After how many values how many agreements a pair must have to go on."""
    ends = [*range(STEP, BANDS * ROWS, STEP), BANDS * ROWS]
    return [(e, next((m for m in range(e + 1) if reach(m, e, t) >= tolerance), e + 1)) for e in ends]


def alike(sig: np.ndarray, i: int, rest: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which documents of ``rest`` the pruning leaves for document ``i``, and their agreements."""
    hits, lo = np.zeros(len(rest), np.int64), 0
    for hi, least in steps:
        hits = hits + (sig[rest, lo:hi] == sig[i, lo:hi]).sum(1)
        go = hits >= least
        rest, hits, lo = rest[go], hits[go], hi
    return rest, hits


def leader_pairs(sig: np.ndarray, t: float, tolerance: float, sure: float = SURE) -> Iterator[tuple[int, np.ndarray]]:
    """Leaders of a bucket, each with the documents that are left for it after the pruning."""
    steps = limits(t, tolerance)
    settled = next((m for m in range(sig.shape[1] + 1) if reach(m, sig.shape[1], t) >= sure), sig.shape[1] + 1)
    free, open_ = np.arange(len(sig)), np.ones(len(sig), bool)
    while len(free):
        i = free[0]
        rest, hits = alike(sig, i, np.flatnonzero(np.arange(len(sig)) != i), steps)
        yield i, rest
        open_[i], open_[rest[hits >= settled]] = False, False
        free = free[1:][open_[free[1:]]]


def bucket_pairs(sig: np.ndarray, t: float, tolerance: float, group: np.ndarray | None = None, main: np.ndarray | None = None, only_main: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Documents of a bucket, each with the later ones that are left for it after the pruning.

    With ``group``, a number for each document, only pairs of different groups are compared; with ``only_main``, only
    those with documents that ``main`` marks.
    """
    steps = limits(t, tolerance)
    if group is None:
        for i in range(len(sig) - 1):
            yield i, alike(sig, i, np.arange(i + 1, len(sig)), steps)[0]
        return
    # the largest group comes last: each document looks only at what lies behind its own group
    _, of, size = np.unique(group, return_inverse=True, return_counts=True)
    last = np.zeros(len(sig), bool) if main is None else main
    order = np.lexsort((of, size[of], last))
    ends = np.append(np.flatnonzero(np.diff(of[order])) + 1, len(order))
    behind = len(order) - int(last.sum())
    for k, i in enumerate(order):
        end = ends[np.searchsorted(ends, k, "right")]
        if end == len(order):
            return
        yield i, alike(sig, i, order[max(end, behind) if only_main else end :], steps)[0]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal ``key`` together, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        border = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip([0, *border], [*border, len(k)]):
            if held and lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def binary_rows(column: pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    raw = column.combine_chunks()
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.chunk(0)
    off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]].view(dtype).reshape(len(raw), width)


def propose(batches: Iterator[pa.RecordBatch], t: float, tolerance: float, way: str = "all") -> Iterator[pa.RecordBatch]:
    """Pairs of buckets: all, those with leaders, or those across groups; input sorted by bucket and id."""
    out_a, out_b, held = [], [], 0
    for group in runs(batches, "key"):
        if group.num_rows < 2:
            continue
        ids = group["id"].to_numpy()
        sig = binary_rows(group["sig"], np.uint16, BANDS * ROWS)
        if way == "leaders":
            found = leader_pairs(sig, t, tolerance)
        elif way == "across":
            found = bucket_pairs(sig, t, tolerance, group["root"].to_numpy(), group["main"].to_numpy(), group["part"][0].as_py() > 0)
        else:
            found = bucket_pairs(sig, t, tolerance)
        for i, others in found:
            if len(others):
                out_a.append(ids[others])
                out_b.append(np.full(len(others), ids[i]))
                held += len(others)
            if held > 100_000:
                yield from _pairs(out_a, out_b)
                out_a, out_b, held = [], [], 0
    yield from _pairs(out_a, out_b)


def _pairs(a: list, b: list) -> Iterator[pa.RecordBatch]:
    if a:
        pair = np.unique(np.stack([np.maximum(np.concatenate(a), np.concatenate(b)), np.minimum(np.concatenate(a), np.concatenate(b))]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["id", "lead"])


def repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose bucket holds another document; input sorted by bucket and id."""
    from grainsieve.llm.anchors import shared_rows

    yield from shared_rows(batches, "key", "id")


def batches_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches again, with the first row of the next joined on, so that no border hides a repeat.

    A repeat over a border shows in one of the two batches for each row of it; rows are
    marked once because the joined row is only looked at, unless it repeats the last row.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        k = batch.column("key")
        cut = batch.num_rows - 1
        head = k[cut].as_py()
        keys = k.to_numpy()
        cut = int(np.searchsorted(keys, head, "left")) if keys[0] != head else 0
        if cut:
            yield batch.slice(0, cut)
        last = batch.slice(cut)
    if last is not None and last.num_rows:
        yield last


def verify(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets reach the threshold; input sorted by leader, its own row first."""
    lead, own = None, None
    for batch in batches:
        docs, leads, scores = [], [], []
        sets = batch.column("set")
        for i, (a, b) in enumerate(zip(batch.column("id").to_pylist(), batch.column("lead").to_pylist())):
            s = np.frombuffer(sets[i].as_buffer(), np.uint64)
            if a == b:
                lead, own = b, s.copy()
                continue
            if lead != b:
                continue
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            both = int((own[at] == s).sum())
            j = both / (len(own) + len(s) - both)
            if j >= t - 1e-9:
                docs.append(a)
                leads.append(b)
                scores.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(leads, pa.int64()), pa.array(scores, pa.float64())], names=["id", "lead", "jaccard"])


def _sketched(kept: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of documents, pairs of equal sets, and the buckets (``key``, ``id``) of more than one document."""
    sketches = written(kept.mapInArrow(lambda x: sketch(x, n), "id long, same long, sig binary, keys array<long>"), "sketches")
    rep = sketches.groupBy("same").agg(F.min("id").alias("lead"))
    equal = sketches.select("id", "same").join(rep, "same").where("id <> lead").select("id", "lead", F.lit(1.0).alias("jaccard"))
    first = sketches.select("id", "same").join(rep, "same").where("id = lead").select("id")
    keyed = sketches.join(first, "id", "left_semi").select("id", F.explode("keys").alias("key"))
    busy = keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(repeated_keys, "id long, key long")
    return sketches.select("id", "sig"), equal, busy


def _verified(kept: DataFrame, with_sig: DataFrame, n: int, threshold: float, tolerance: float, way: str) -> DataFrame:
    """Pairs that buckets propose, verified on the full sets."""
    proposed = with_sig.repartition("key").sortWithinPartitions("key", "id").mapInArrow(lambda x: propose(x, threshold, tolerance, way), "id long, lead long").distinct()
    proposed = written(proposed, "proposed")
    # a leader of many documents is compared in several tasks, each with its set
    parts = proposed.groupBy("lead").agg(F.ceil(F.count("*") / LEAD_ROWS).alias("parts"))
    members = proposed.join(parts, "lead").select("id", F.struct("lead", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).alias("to"))
    own = parts.select(F.col("lead").alias("id"), F.explode(F.expr("transform(sequence(0L, parts - 1), p -> struct(lead AS lead, p AS part))")).alias("to"))
    sides = members.unionByName(own).groupBy("id").agg(F.collect_set("to").alias("leads"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, head = shingle_sets(b, n)
                data = pa.array([h[x:y].tobytes() for x, y in zip(head[:-1], head[1:])], pa.binary())
                part = batch.slice(b.lo, b.hi - b.lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), data], names=["id", "leads", "set"])

    # the same shuffled join at every size: its plan does not hang on an estimate of the ids
    rows = kept.join(sides.hint("merge"), "id").select("id", "text", "leads").mapInArrow(sets, "id long, leads array<struct<lead:long,part:long>>, set binary")
    rows = rows.select(F.inline("leads"), "id", "set")
    ordered = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("id") != F.col("lead"), "id").select("id", "lead", "set")
    return ordered.mapInArrow(lambda x: verify(x, threshold), "id long, lead long, jaccard double")


def similar_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """All verified pairs (``id``, ``lead``, ``jaccard``) of sets; equal sets are paired, with 1.0, with the smallest id of their class only, which stands for them in the other pairs."""
    number = Ids(docs, id_col)
    kept = number.rows(docs, F.col(f"`{text_col}`").alias("text"))
    sigs, equal, busy = _sketched(kept, n)
    out = _verified(kept, busy.join(sigs, "id").select("key", "id", "sig"), n, threshold, tolerance, "all").unionByName(equal)
    return number.back(out, id="id", lead="lead")


def _parted(rows: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """(key, id) with the keys of crowded buckets split by id, and the keys of the crowded ones."""
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("key", F.ceil(F.col("n") / bucket_rows).alias("parts"))
    crowded = written(crowded, "crowded")
    key = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("id"), F.col("parts"))))
    return rows.join(crowded, "key", "left").select(key.alias("key"), "id"), crowded.select("key")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every document with a near duplicate: its id and its group, the smallest id of the group."""
    number = Ids(docs, id_col)
    kept = number.rows(docs, F.col(f"`{text_col}`").alias("text"))
    sigs, equal, busy = _sketched(kept, n)
    busy = written(busy, "buckets")
    with_sig = lambda rows: rows.join(sigs, "id").select("key", "id", "sig")
    parted, crowded = _parted(busy, bucket_rows)
    some = _verified(kept, with_sig(parted), n, threshold, tolerance, "leaders").unionByName(equal)
    joined = components(some, "id", "lead")
    root = lambda rows: rows.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    links = lambda: joined.select(F.col("node").alias("id"), F.col("root").alias("lead"))
    before = None
    while not crowded.isEmpty():
        stand = written(root(busy.join(crowded, "key", "left_semi")).groupBy("key", "root").agg(F.min("id").alias("id")).select("key", "id"), "stand")
        left = stand.count()
        if left == before:
            break
        before = left
        more = _verified(kept, with_sig(_parted(stand, bucket_rows)[0]), n, threshold, tolerance, "leaders")
        joined = components(links().unionByName(more.select("id", "lead")), "id", "lead")
    rooted = written(root(busy), "rooted")
    # buckets with several groups, their size and their largest group
    groups = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("g"), F.sum("c").alias("n"), F.max_by("root", F.struct("c", "root")).alias("most"))
    mixed = groups.where("g > 1").select("key", "most", F.ceil(F.col("n") / bucket_rows).alias("parts"))
    dealt = rooted.join(mixed, "key").withColumn("main", F.col("root") == F.col("most"))
    own = F.array(F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("main"), own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    dealt = dealt.withColumn("key", F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", "part")))
    across = _verified(kept, dealt.join(sigs, "id").select("key", "id", "sig", "root", "main", "part"), n, threshold, tolerance, "across")
    rest = components(links().unionByName(across.select("id", "lead")), "id", "lead")
    roots = rest.select(F.col("root").alias("node"), "root").distinct()
    return number.back(rest.unionByName(roots), node=id_col, root="group_id")


ORACLE = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{SQL_SEPARATOR}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, w[p]||' '||w[p+1]||' '||w[p+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {N - 2})) AS p FROM dw WHERE len(w) >= {N})
       UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM dw WHERE len(w) BETWEEN 1 AND {N - 1}),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pair AS (SELECT x, y FROM both_have JOIN sz a ON a.doc_id = x JOIN sz b ON b.doc_id = y WHERE c >= {THRESHOLD} * (a.n + b.n - c) - 1e-9),
linked(x, y) AS (SELECT x, y FROM pair UNION SELECT l.x, p.y FROM linked l JOIN pair p ON p.x = l.y)
SELECT x AS doc_id, min(y) AS group_id FROM linked GROUP BY x
"""
