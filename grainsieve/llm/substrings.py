"""Repeated passages by prefix-partitioned suffix trees (operator 2).

Words of a document are compared by hash. Suffixes begin at anchors (see ``anchors``), of which
every passage of ``length`` words has one and each of its copies the same. A prefix of ``N`` words
that only one document has can't begin a repeat; the other suffixes are partitioned by theirs,
and where more than ``group_rows`` share it, by longer ones: a prefix is lengthened until it reaches over all
``length`` words, to the right of the n-gram or to the left, once for each place that the n-gram can have in
such a run. Groups of whole runs need no tree: their suffixes agree to the depth that counts, and
stream by in order, however many there are. So no group is larger in memory than ``group_rows``.

Each group is sorted into a suffix tree over the words to the right: its internal nodes are the
runs of suffixes that agree to some depth. Within a node, suffixes sorted by the words to the left
give the longest extension that another document shares. Nodes so deep that both sides
together reach ``length`` are maximal repeats; suffixes with equal surroundings on both sides
are one leaf. Overlapping repeats of a document are joined.

Results are word positions in a document (words as in ``words``). Documents with null id, null or
empty text and those shorter than ``length`` have no rows. Rows that repeat an id are one document,
so that they aren't each other's repeats; repeats within one document don't count either. Ids may be of any type.
Other columns, whatever their names, aren't read. An empty table gives an empty result. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.anchors import anchors, shared_rows
from grainsieve.llm.ids import Ids
from grainsieve.llm.words import SQL_SEPARATOR, Block, blocks, gram_hash, mix, signed

LENGTH = 50
N = 16
WIDTH = 3
GROUP_ROWS = 1 << 18


def contexts(b: Block, at: np.ndarray, reach: int) -> tuple[list[bytes], list[bytes]]:
    """The words after each n-gram, and those before it from right to left, at ``WIDTH`` bytes a word."""
    code = np.ascontiguousarray((b.code >> np.uint64(8 * (8 - WIDTH))).astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :WIDTH]
    doc = np.searchsorted(b.first, at, "right") - 1
    ahead = np.minimum(reach, b.first[doc + 1] - at - N)
    behind = np.minimum(reach, at - b.first[doc])
    forward, backward = code.tobytes(), code[::-1].tobytes()
    n = len(code)
    right = [forward[WIDTH * (p + N) : WIDTH * (p + N + k)] for p, k in zip(at.tolist(), ahead.tolist())]
    left = [backward[WIDTH * (n - p) : WIDTH * (n - p + k)] for p, k in zip(at.tolist(), behind.tolist())]
    return right, left


def matrix(column: pa.Array, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte rows padded with zeros, and their lengths in words."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(off)
    out = np.zeros((len(column), WIDTH * reach), np.uint8)
    out[np.arange(WIDTH * reach) < size[:, None]] = raw[off[0] : off[-1]]
    return out, size // WIDTH


def agree(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Words that rows a and b have in common from the start."""
    differ = a != b
    where = np.where(differ.any(1), differ.argmax(1), a.shape[1]) // WIDTH
    return np.minimum(where, np.minimum(size_a, size_b))


def _since(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running minimum that begins anew where ``start`` is set."""
    part = np.cumsum(start) * 1000
    return np.minimum.accumulate(values - part) + part


def other_document(doc: np.ndarray, run: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For sorted rows, the longest agreement with a row of another document in the same run (-1: none).

    ``common`` has each row's agreement with the row before; it's -1 at the start of a run.
    """
    out = np.full(len(doc), -1)
    for flip in (False, True):
        d, r = (doc[::-1], run[::-1]) if flip else (doc, run)
        c = np.append(-1, common[:0:-1]) if flip else common
        first = np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]))
        got = _since(np.where(np.append(True, r[1:] != r[:-1]), -1, c), first)
        out = np.maximum(out, got[::-1] if flip else got)
    return out


def tree_extents(group: np.ndarray, right: pa.Array, left: pa.Array, doc: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before and after each suffix's n-gram that belong to maximal repeats (-1: none).

    Suffixes are sorted by group and right side. ``many`` marks leaves of several documents.
    """
    reach = length - N
    r, rs = matrix(right, reach)
    lft, ls = matrix(left, reach)
    n = len(group)
    before, after = np.full(n, -1), np.full(n, -1)
    whole = many & (ls + rs + N >= length)
    before[whole], after[whole] = ls[whole], rs[whole]
    doc = np.where(many, -1 - np.arange(n), doc)
    depth = np.full(n, -1)
    if n > 1:
        same = group[1:] == group[:-1]
        depth[1:] = np.where(same, agree(r[1:], r[:-1], rs[1:], rs[:-1]), -1)
    order_left = np.argsort(lft.view(f"S{lft.shape[1]}").ravel(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order_left] = np.arange(n)
    for level in range(reach, -1, -1):
        here = depth == level
        if not here.any():
            continue
        run = np.cumsum(depth < level)
        node = np.zeros(run[-1] + 1, bool)
        node[run[here]] = True
        at = np.flatnonzero(node[run])
        at = at[np.lexsort((rank[at], run[at]))]
        common = np.full(len(at), -1)
        same = run[at[1:]] == run[at[:-1]]
        common[1:] = np.where(same, agree(lft[at[1:]], lft[at[:-1]], ls[at[1:]], ls[at[:-1]]), -1)
        got = other_document(doc[at], run[at], common)
        deep = got + N + level >= length
        hit = at[deep & (got >= 0)]
        before[hit] = np.maximum(before[hit], got[deep & (got >= 0)])
        after[hit] = np.maximum(after[hit], level)
    return before, after


def grow(batches: Iterator[pa.RecordBatch], length: int, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Spans of repeats; input sorted by group, right side, left side and document. Rows without sides are whole runs."""
    streamed, last = _Runs(length), None
    for batch in batches:
        run = batch.column("right").is_null()
        yield from streamed.push(batch.filter(run))
        part = batch.filter(pc.invert(run))
        if not part.num_rows:
            continue
        if last is not None:
            part = pa.Table.from_batches([last, part]).combine_chunks().to_batches()[0]
        key = part.column("key").to_numpy()
        # the last group may go on in the next batch
        at = int(np.searchsorted(key, key[-1], "left"))
        yield from tree_spans(part.slice(0, at), length, rows)
        last = part.slice(at)
    if last is not None:
        yield from tree_spans(last, length, rows)


class _Runs:
    """Spans of whole runs that several documents have, from rows sorted by key and document in any number of pushes."""

    def __init__(self, length: int):
        self.length, self.held, self.told = length, None, None

    def push(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        batch = batch.select(["key", "id", "pos"])
        if self.held is not None:
            batch, self.held = pa.Table.from_batches([self.held, batch]).combine_chunks().to_batches()[0], None
        k, d = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        many = (np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)) | (k[head] == self.told if self.told is not None else False)
        self.told = k[-1] if many[-1] else None
        if self.told is None:
            self.held = batch.slice(int(head[-1]))
        on = np.repeat(many, np.diff(np.append(head, len(k))))
        if on.any():
            pos = batch.column("pos").to_numpy()[on]
            yield pa.RecordBatch.from_arrays([pa.array(d[on]), pa.array(pos), pa.array(pos + np.int32(self.length))], names=["id", "start", "end"])


def tree_spans(batch: pa.RecordBatch, length: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Spans of the repeats of whole groups, some groups at a time."""
    cut = [0]
    keys = batch.column("key").to_numpy()
    borders = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    while cut[-1] < len(keys):
        cut.append(int(borders[min(np.searchsorted(borders, cut[-1] + rows), len(borders) - 1)]))
    for lo, hi in zip(cut[:-1], cut[1:]):
        part = batch.slice(lo, hi - lo)
        key, doc, pos = keys[lo:hi], part.column("id").to_numpy(), part.column("pos").to_numpy()
        right, left = part.column("right"), part.column("left")
        new = np.ones(len(key), bool)
        if len(key) > 1:
            same = (key[1:] == key[:-1]) & _equal_rows(right) & _equal_rows(left)
            new[1:] = ~same
        leaf = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        many = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
        take = pa.array(head)
        before, after = tree_extents(key[head], right.take(take), left.take(take), doc[head], many, length)
        hit = np.flatnonzero(after[leaf] >= 0)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array((pos[hit] - before[leaf[hit]]).astype(np.int32)), pa.array((pos[hit] + N + after[leaf[hit]]).astype(np.int32))], names=["id", "start", "end"])


def _equal_rows(column: pa.Array) -> np.ndarray:
    """Whether each binary row but the first equals the one before."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(off)
    width = int(size.max()) if len(size) else 0
    rows = np.zeros((len(column), max(1, width)), np.uint8)
    rows[np.arange(max(1, width)) < size[:, None]] = raw[off[0] : off[-1]]
    return (size[1:] == size[:-1]) & (rows[1:] == rows[:-1]).all(1)


def joined_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching (id, start, end) of each document as one."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.array([(p["start"], p["end"]) for p in pairs], np.int64)
                a = a[np.argsort(a[:, 0])]
                top = np.maximum.accumulate(a[:, 1])
                new = np.append(True, a[1:, 0] > top[:-1])
                ids += [i] * int(new.sum())
                starts += a[new, 0].tolist()
                ends += top[np.append(new[1:], True)].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "start", "end"])

    grouped = spans.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return grouped.mapInArrow(join, "id long, start int, end int")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``id_col``, ``start_word`` and ``end_word`` (exclusive) of all passages of at least ``length`` words that another document has too."""
    window = length - N + 1
    reach = length - N
    if window < 1:
        raise ValueError(f"length must be at least {N}")
    number = Ids(docs, id_col)
    kept = number.rows(docs, F.col(f"`{text_col}`").alias("text"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, at = anchors(b, N, window)
                doc = np.searchsorted(b.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), batch.column(0).take(pa.array(b.lo + doc)), pa.array((at - b.first[doc]).astype(np.int32))], names=["key", "id", "pos"])

    prefixes = kept.mapInArrow(begin, "key long, id long, pos int")
    shared = prefixes.repartition("key").sortWithinPartitions("key", "id").mapInArrow(lambda x: _with_heat(x, group_rows), "id long, pos int, hot boolean")
    sides = shared.groupBy("id").agg(F.collect_list(F.struct("pos", "hot")).alias("at"))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
            values = lists.values
            all_pos, all_hot = values.field(0).to_numpy(), values.field(1).to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(1)):
                lo, hi = off[b.lo], off[b.hi]
                doc = np.repeat(np.arange(b.hi - b.lo), np.diff(off[b.lo : b.hi + 1]))
                at, hot = all_pos[lo:hi] + b.first[doc], all_hot[lo:hi]
                # rows that repeat an id with another text may lack a position
                ok = at + N <= b.first[doc + 1]
                doc, at, hot = doc[ok], at[ok], hot[ok]
                if len(at):
                    right, left = contexts(b, at, reach)
                    yield from _keyed(b, batch.column(0), doc, at, hot, right, left, length)

    rows = kept.join(sides.hint("merge"), "id").select("id", "text", "at").mapInArrow(surround, "key long, id long, pos int, right binary, left binary")
    spans = rows.repartition("key").sortWithinPartitions("key", "right", "left", "id").mapInArrow(lambda x: grow(x, length), "id long, start int, end int")
    out = joined_spans(spans).select("id", F.col("start").alias("start_word"), F.col("end").alias("end_word"))
    return number.back(out, id=id_col)


def _with_heat(batches: Iterator[pa.RecordBatch], group_rows: int) -> Iterator[pa.RecordBatch]:
    """(id, pos, hot) of the shared prefixes; at most ``group_rows`` rows of a prefix are held until it's known to be crowded."""

    def marked(part: pa.RecordBatch, hot: bool | np.ndarray) -> pa.RecordBatch:
        hot = np.full(part.num_rows, hot) if isinstance(hot, bool) else hot
        return pa.RecordBatch.from_arrays([part.column("id"), part.column("pos"), pa.array(hot)], names=["id", "pos", "hot"])

    held, n, hot, key = [], 0, False, None
    for batch in shared_rows(batches, "key", "id"):
        k = batch.column("key").to_numpy()
        head = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
        at = 0
        if k[0] == key:
            part, at = batch.slice(0, int(head[1])), 1
            n += part.num_rows
            held.append(part)
            if hot or n > group_rows:
                hot = True
                yield from (marked(h, True) for h in held)
                held = []
        if at + 1 >= len(head):
            continue
        yield from (marked(h, False) for h in held)
        lo, hi = int(head[at]), int(head[-2])
        if hi > lo:
            size = np.diff(head[at:-1])
            yield marked(batch.slice(lo, hi - lo), np.repeat(size > group_rows, size))
        held, key, n = [batch.slice(hi)], k[-1], len(k) - hi
        hot = n > group_rows
        if hot:
            yield marked(held.pop(), True)
    yield from (marked(h, False) for h in held)


def _keyed(b: Block, ids: pa.Array, doc: np.ndarray, at: np.ndarray, hot: np.ndarray, right: list[bytes], left: list[bytes], length: int) -> Iterator[pa.RecordBatch]:
    """Rows with the hash of their prefix; suffixes of crowded prefixes once for each run of ``length`` words around, with its start and no sides."""
    id_of = ids.take(pa.array(b.lo + doc))
    pos = (at - b.first[doc]).astype(np.int32)
    calm = np.flatnonzero(~hot)
    if len(calm):
        take = pa.array(calm)
        sides = [pa.array([side[i] for i in calm.tolist()], pa.binary()) for side in (right, left)]
        yield pa.RecordBatch.from_arrays([pa.array(signed(gram_hash(b.code, at[calm], N))), id_of.take(take), pa.array(pos[calm]), *sides], names=["key", "id", "pos", "right", "left"])
    for back in range(length - N + 1) if hot.any() else ():
        start = at - back
        rows = np.flatnonzero(hot & (start >= b.first[doc]) & (start + length <= b.first[doc + 1]))
        if len(rows):
            none = pa.nulls(len(rows), pa.binary())
            key = mix(gram_hash(b.code, start[rows], length) + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), id_of.take(pa.array(rows)), pa.array(pos[rows] - np.int32(back)), none, none], names=["key", "id", "pos", "right", "left"])


ORACLE = rf"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{SQL_SEPARATOR}'), lambda x: x <> '') AS w FROM documents),
gram AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + {LENGTH - 1}), ' ')) AS g
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS p FROM dw)),
many AS (SELECT g FROM gram GROUP BY g HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM gram WHERE g IN (SELECT g FROM many)),
isle AS (SELECT doc_id, p, count(*) FILTER (WHERE gap > {LENGTH}) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit)
SELECT doc_id, CAST(min(p) - 1 AS INTEGER) AS start_word, CAST(max(p) - 1 + {LENGTH} AS INTEGER) AS end_word FROM isle GROUP BY doc_id, k
"""
