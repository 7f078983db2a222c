"""Approximate nearest neighbours by robust-pruned directed graphs (operator 1).

Rows are dealt to shards of about ``shard_rows`` by hash of the id. Each shard builds one graph: points
are inserted in batches; a greedy search of the graph so far proposes a point's neighbours, and
relaxed pruning keeps, from the nearest on, those that no kept one is ``alpha`` times nearer to.
Kept edges are entered in both directions, crowded nodes are pruned again. Every row is indexed; the
queries are the rows that ``asked`` holds for. A beam search of each shard's graph finds a query's best
candidates there, and the best ``k`` of all shards are its neighbours. A query costs a beam search per
shard, so the work of queries grows with their number times shards: shards should be as large as a
task's memory takes (about 0.6 KB a row of 64 numbers).

Distances are Euclidean. A row isn't its own neighbour. Equal vectors of a shard are one node and are
all found with it; ties go to the smaller id. Vectors have neighbours of their own size only: each size
has shards of its own. Rows with a null id or vector, or with a vector that is empty or holds null, NaN
or infinite numbers, are no queries and no neighbours. Rows that repeat an id count once, with
the shortest, of those the smallest, vector. Ids may be of any type. A query has fewer than ``k`` neighbours
where the table has too few, and no rows where it has none. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.ids import Ids
from grainsieve.llm.jaccard import batches_by_key
from grainsieve.llm.store import written

K = 10
DEGREE = 40
BEAM = 80
ALPHA = 1.2
SHARD_ROWS = 1 << 14
SLICE_ROWS = 1 << 13
WIDE = 4  # nodes that a search expands at a time
BATCH = 512
TASKS = 1 << 15


def sorted_beam(ids: np.ndarray, dist: np.ndarray, done: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if ids.shape[1] > beam:
        keep = np.argpartition(dist, beam - 1, 1)[:, :beam]
        ids, dist, done = (np.take_along_axis(v, keep, 1) for v in (ids, dist, done))
    order = np.argsort(dist, 1)
    return tuple(np.take_along_axis(v, order, 1) for v in (ids, dist, done))


def search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best nodes of each query (-1: none), and their squared distances less the query's own norm."""
    n, n_q = len(x), len(queries)
    out_ids, out_dist = np.full((n_q, beam), -1, np.int32), np.full((n_q, beam), np.inf, np.float32)
    live = np.arange(n_q)
    seen = np.zeros(n_q * n, bool)
    seen[live * n + start] = True
    ids = np.full((n_q, 1), start, np.int32)
    dist = (norms[start] - 2 * (queries @ x[start]))[:, None].astype(np.float32)
    done = np.zeros((n_q, 1), bool)
    while len(live):
        pick = ~done & (np.cumsum(~done, 1, dtype=np.int32) <= WIDE)
        rows, cols = np.nonzero(pick)
        done |= pick
        near = graph[ids[rows, cols]]
        key = (near + (live[rows] * n)[:, None])[near >= 0]
        key = np.sort(key[~seen[key]])
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        seen[key] = True
        border = np.searchsorted(key, np.append(live * n, n_q * n))
        count = np.diff(border)
        width = int(count.max())
        if width:
            held = np.arange(width) < count[:, None]
            new_ids = np.full((len(live), width), -1, np.int32)
            new_ids[held] = key - np.repeat(live * n, count)
            new_dist = norms[new_ids] - 2 * np.matmul(x[new_ids], queries[live][:, :, None])[:, :, 0]
            new_dist[~held] = np.inf
            ids = np.concatenate([ids, new_ids], 1)
            dist = np.concatenate([dist, new_dist], 1)
            done = np.concatenate([done, ~held], 1)
        ids, dist, done = sorted_beam(ids, dist, done, beam)
        over = done.all(1)
        if over.any():
            out_ids[live[over], : ids.shape[1]] = ids[over]
            out_dist[live[over], : ids.shape[1]] = dist[over]
            ids, dist, done, live = ids[~over], dist[~over], done[~over], live[~over]
    return out_ids, out_dist


def prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of each point's candidates (-1: none), diverse ones, nearest first."""
    diff = x[cand] - x[points][:, None]
    dist = np.einsum("bcd,bcd->bc", diff, diff)
    dist[(cand < 0) | (cand == points[:, None])] = np.inf
    order = np.argsort(dist, 1)
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    v = x[cand]
    sq = np.einsum("bcd,bcd->bc", v, v)
    between = np.matmul(v, v.transpose(0, 2, 1))
    between *= -2
    between += sq[:, :, None]
    between += sq[:, None, :]
    alive = np.isfinite(dist)
    out = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = cand[rows[some], first[some]]
        alive &= alpha * alpha * between[rows, first] > dist
        alive[rows, first] = False
    return out


def build(x: np.ndarray, *, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph of distinct vectors: out-edges of each (-1: none), and where searches start."""
    n = len(x)
    room = degree + degree // 2
    graph = np.full((n, room), -1, np.int32)
    used = np.zeros(n, np.int64)
    norms = np.einsum("ij,ij->i", x, x)
    start = int((norms - 2 * (x @ x.mean(0))).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        points = order[at : at + min(BATCH, max(1, at // 4))]
        at += len(points)
        found, _ = search(x, norms, graph, start, x[points], beam)
        # points of one batch don't see each other yet: the nearest of them are candidates too
        if len(points) > 1:
            d = norms[points][None] - 2 * (x[points] @ x[points].T)
            np.fill_diagonal(d, np.inf)
            few = min(16, len(points) - 1)
            found = np.concatenate([found, points[np.argpartition(d, few - 1, 1)[:, :few]].astype(np.int32)], 1)
        near = prune(x, points, found, degree, alpha)
        graph[points, :degree] = near
        used[points] = (near >= 0).sum(1)
        src, dst = np.repeat(points, degree), near.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        enter(x, graph, used, src, dst, degree, alpha)
    return graph, start


def enter(x: np.ndarray, graph: np.ndarray, used: np.ndarray, src: np.ndarray, dst: np.ndarray, degree: int, alpha: float) -> None:
    """Enters the edges dst to src; nodes without room for theirs are pruned."""
    order = np.argsort(dst, kind="stable")
    src, dst = src[order].astype(np.int32), dst[order]
    node, head, count = np.unique(dst, return_index=True, return_counts=True)
    known = (graph[dst] == src[:, None]).any(1)
    fits = used[node] + count <= graph.shape[1]
    easy = np.repeat(fits, count) & ~known
    d, s = dst[easy], src[easy]
    if len(d):
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        size = np.diff(np.append(first, len(d)))
        graph[d, used[d] + np.arange(len(d)) - np.repeat(first, size)] = s
        used[d[first]] += size
    full = np.flatnonzero(~fits)
    full = full[np.argsort(count[full])]
    for lo in range(0, len(full), 256):
        part = full[lo : lo + 256]
        width = int(count[part].max())
        more = np.full((len(part), width), -1, np.int32)
        row = np.repeat(np.arange(len(part)), count[part])
        col = np.arange(len(row)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        at = head[part][row] + col
        more[row, col] = np.where(known[at], -1, src[at])
        kept = prune(x, node[part], np.concatenate([graph[node[part]], more], 1), degree, alpha)
        graph[node[part]] = -1
        graph[node[part], :degree] = kept
        used[node[part]] = (kept >= 0).sum(1)


def vectors(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return raw[off[0] : off[-1]].view(np.float32).reshape(len(column), -1)


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("v")
        x = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32))
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        off = (np.append(0, np.cumsum(size)) * 4).astype(np.int32)
        vector = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(x)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asked"), pa.array(size.astype(np.int32)), vector], names=["id", "asked", "dim", "vector"])


def build_shards(batches: Iterator[pa.RecordBatch], degree: int, beam: int, alpha: float) -> Iterator[pa.RecordBatch]:
    """One row a shard: its ids, the node of each, the nodes' vectors and edges. Input sorted by shard and id."""
    for batch in batches_by_key(batches):
        key = batch.column("key").to_numpy()
        border = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for lo, hi in zip(border[:-1], border[1:]):
            part = batch.slice(lo, hi - lo)
            x = vectors(part.column("vector"))
            nodes, node = np.unique(x, axis=0, return_inverse=True)
            graph, start = build(np.ascontiguousarray(nodes), degree=degree, beam=beam, alpha=alpha)
            graph = graph[:, : max(1, int((graph >= 0).sum(1).max()))]
            blobs = [part.column("id").to_numpy(), node.astype(np.int32).ravel(), nodes, np.ascontiguousarray(graph)]
            yield pa.RecordBatch.from_arrays([pa.array([int(key[lo])]), pa.array([start], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["key", "start", "ids", "node", "nodes", "graph"])


def query_shards(batches: Iterator[pa.RecordBatch], k: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Neighbours of queries in a shard; input: a shard's index, then its queries."""
    ids = members = first = nodes = norms = graph = start = None
    for batch in batches:
        is_index = batch.column("ids").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(is_index), batch.num_rows)
        spans = [(0, int(cuts[0]))] if cuts[0] else []
        spans += [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]
        for lo, hi in spans:
            if is_index[lo]:
                row = batch.slice(lo, 1)
                blob = {c: row.column(c)[0].as_buffer() for c in ("ids", "node", "nodes", "graph")}
                all_ids, node = np.frombuffer(blob["ids"], np.int64), np.frombuffer(blob["node"], np.int32)
                nodes = np.frombuffer(blob["nodes"], np.float32).reshape(int(node.max()) + 1, -1)
                graph = np.frombuffer(blob["graph"], np.int32).reshape(len(nodes), -1)
                start, norms = row.column("start")[0].as_py(), np.einsum("ij,ij->i", nodes, nodes)
                by_node = np.lexsort((all_ids, node))
                ids, members = all_ids[by_node], node[by_node]
                first = np.searchsorted(members, np.arange(len(nodes) + 1))
                lo += 1
            for a in range(lo, hi, BATCH):
                part = batch.slice(a, min(BATCH, hi - a))
                own, q = part.column("id").to_numpy(), vectors(part.column("vector"))
                got, dist = search(nodes, norms, graph, start, q, beam)
                yield best(own, q, got, dist, ids, first, k)


def best(own: np.ndarray, q: np.ndarray, got: np.ndarray, dist: np.ndarray, ids: np.ndarray, first: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest rows of each query among the nodes found."""
    got, dist = got[:, : k + 1], dist[:, : k + 1]
    row, col = np.nonzero(got >= 0)
    node = got[row, col]
    size = np.minimum(first[node + 1] - first[node], k + 1)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[node], size)
    other, owner = ids[at], np.repeat(row, size)
    d = np.repeat(dist[row, col] + np.einsum("ij,ij->i", q, q)[row], size)
    d = np.sqrt(np.maximum(d, 0)).astype(np.float64)
    keep = other != own[owner]
    other, owner, d = other[keep], owner[keep], d[keep]
    order = np.lexsort((other, d, owner))
    other, owner, d = other[order], owner[order], d[order]
    count = np.bincount(owner, minlength=len(own))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    keep = place < k
    off = np.append(0, np.cumsum(np.minimum(count, k))).astype(np.int32)
    near = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(d[keep]), pa.array(other[keep])], ["distance", "id"]))
    return pa.RecordBatch.from_arrays([pa.array(own), near], names=["id", "near"])


def nearest(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", asked: str | Column = "true", k: int = K, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA,
    shard_rows: int = SHARD_ROWS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``id_col``, ``rank`` (from 1), ``neighbour`` and ``distance`` of the k nearest rows of every row that ``asked``, a condition on the table, holds for."""
    number = Ids(table, id_col)
    condition = F.expr(asked) if isinstance(asked, str) else asked
    rows = number.rows(table, F.coalesce(condition, F.lit(False)).alias("asked"), F.col(f"`{vector_col}`").cast("array<float>").alias("v"))
    rows = rows.where("size(v) > 0 and forall(v, a -> a is not null and not isnan(a) and abs(a) < float('inf'))")
    one = rows.groupBy("id").agg(F.max("asked").alias("asked"), F.min(F.struct(F.size("v").alias("size"), "v"))["v"].alias("v"))
    points = written(one.mapInArrow(as_bytes, "id long, asked boolean, dim int, vector binary"), "points")
    # one row for each size of vectors; dealt out by a join, since how many there are isn't known
    sizes = points.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asked").alias("n_asked"))
    sizes = sizes.select("dim", F.ceil(F.col("n") / shard_rows).alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("n_asked") / slice_rows)).alias("slices"))
    sizes = written(sizes, "sizes")
    shards, pairs = sizes.agg(F.coalesce(F.sum("shards"), F.lit(0)), F.coalesce(F.sum(F.col("shards") * F.col("slices")), F.lit(0))).first()
    key = lambda shard: (F.col("dim").cast("long") * (1 << 40) + shard).alias("key")
    sized = points.join(sizes, "dim")
    index_schema = "key long, start int, ids binary, node binary, nodes binary, graph binary"
    # as many tasks as shards: their bytes say little about the work
    keyed = sized.select(key(F.pmod(F.xxhash64("id"), F.col("shards"))), "id", "vector").repartition(max(1, min(shards, TASKS)), "key")
    index = written(keyed.sortWithinPartitions("key", "id").mapInArrow(lambda b: build_shards(b, degree, beam, alpha), index_schema), "graphs")
    to = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
    questions = sized.where("asked").select("dim", "id", "vector", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("slices")).alias("slice"), to).select(key(F.col("shard")), "id", "vector", "slice")
    of = F.shiftright("key", 40).cast("int")
    told = index.withColumn("dim", of).join(sizes, "dim").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("dim", "shards", "slices")
    both = told.unionByName(questions, allowMissingColumns=True)
    ordered = both.repartition(max(1, min(pairs, TASKS)), "key", "slice").sortWithinPartitions("key", "slice", F.col("ids").isNull())
    found = ordered.mapInArrow(lambda b: query_shards(b, k, beam), "id long, near array<struct<distance:double,id:long>>")
    top = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    out = top.select("id", F.posexplode("near").alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("other"), F.col("x.distance").alias("distance"))
    return number.back(out, id=id_col, other="neighbour")
