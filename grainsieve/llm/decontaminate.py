"""Benchmark decontamination by a prefix-filtered set join (operator 8).

An item's shingles are its distinct runs of ``n`` words. A document contains an item where
some window of as many words as the item has at least ``containment`` of the item's shingles.
Shingles are ordered by rarity over all documents. With m shingles of which r must occur, any
match has one of the item's m - r + 1 rarest (prefix filter): a document's shingles are looked up among
these prefixes only, and a document without any is done. All shingles are looked up for
the blocks of documents and items that are left; windows that begin at a shingle of the item, are no longer than
it and hold enough positions of it (length and positional bounds) are then counted exactly.

The items are read in portions of at most ``portion`` shingles. Each portion, of bounded size,
is broadcast, and the documents are scanned once for it without a shuffle: a larger benchmark
takes more scans, never a larger broadcast.

Null or empty texts hold nothing, long ones are read whole; empty tables give empty results. Items with fewer than ``n`` words have no shingles and match
nothing. Each row of either table counts by itself: repeated rows give repeated results, and
a document that matches several items gives a row for each. Rows with null item ids are kept,
with a null id. Ids may be of any type. Other columns of the tables, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.store import written
from grainsieve.llm.words import SQL_SEPARATOR, Block, blocks, ranges, signed

N = 3
CONTAINMENT = 0.7
PORTION = 2_000_000


@dataclass
class Portion:
    """Items as arrays: item ids, words and distinct shingles of each, and (shingle, item) sorted by shingle."""

    ids: pa.Array
    words: np.ndarray
    size: np.ndarray
    shingle: np.ndarray
    item: np.ndarray
    prefix: np.ndarray | None = None
    #: (shingle, item) of prefixes only, sorted by shingle, and their distinct shingles
    first: np.ndarray | None = None
    first_item: np.ndarray | None = None
    firsts: np.ndarray | None = None
    #: shingles sorted by item and shingle, and where each item's begin
    by_item: np.ndarray | None = None
    item_head: np.ndarray | None = None


def read_portion(ids: pa.Array, texts: pa.Array, n: int) -> Portion:
    words, size, shingle, item = [], [], [], []
    for b in blocks(texts):
        h, at = b.grams(n)
        own = b.owner[at]
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[new], own[new]
        words.append(np.diff(b.first))
        size.append(np.bincount(own, minlength=b.hi - b.lo))
        shingle.append(h)
        item.append(own + b.lo)
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    shingle, item = join(shingle, np.uint64), join(item, np.int64)
    order = np.argsort(shingle, kind="stable")
    return Portion(ids, join(words, np.int64), join(size, np.int64), shingle[order], item[order])


def needed(size: np.ndarray, containment: float) -> np.ndarray:
    return np.maximum(1, np.ceil(containment * size - 1e-9)).astype(np.int64)


def set_prefixes(p: Portion, known: np.ndarray, count: np.ndarray, containment: float) -> None:
    """Marks each item's rarest shingles, of which any match has one."""
    at = np.minimum(np.searchsorted(known, p.shingle), max(0, len(known) - 1))
    freq = np.where(known[at] == p.shingle, count[at], 0) if len(known) else np.zeros(len(p.shingle), np.int64)
    order = np.lexsort((p.shingle, freq, p.item))
    place = np.arange(len(order)) - np.repeat(np.cumsum(p.size) - p.size, p.size)
    p.prefix = np.zeros(len(order), bool)
    p.prefix[order] = place <= (p.size - needed(p.size, containment))[p.item[order]]
    p.first, p.first_item = p.shingle[p.prefix], p.item[p.prefix]
    p.firsts = np.unique(p.first)
    p.by_item = p.shingle[np.lexsort((p.shingle, p.item))]
    p.item_head = np.append(0, np.cumsum(p.size))


def lookups(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hit of ``h`` in the sorted ``table`` (which may repeat): the index in h, the index in table."""
    lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
    n = hi - lo
    src = np.repeat(np.arange(len(h)), n)
    return src, np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def matches(texts: pa.Array, p: Portion, n: int, containment: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``texts``, items, and the largest share of an item's shingles in a window."""
    rows, items, share = [], [], []
    need = needed(p.size, containment)
    for b in blocks(texts):
        h, at = b.grams(n)
        if not len(h) or not len(p.firsts):
            continue
        slot = np.minimum(np.searchsorted(p.firsts, h), len(p.firsts) - 1)
        hit = np.flatnonzero(p.firsts[slot] == h)
        if not len(hit):
            continue
        src, entry = lookups(p.first, h[hit])
        wanted = np.unique(b.owner[at[hit]][src] * len(p.ids) + p.first_item[entry])
        src, entry, pair = _positions(b, h, at, wanted, p)
        item, pos = pair % len(p.ids), at[src]
        # the last hit within the window that begins at each hit
        reach = pos + np.maximum(p.words[item] - n, 0)
        key = pair * (len(b.code) + 1) + pos
        last = np.searchsorted(key, pair * (len(b.code) + 1) + np.minimum(reach, len(b.code)), "right")
        start = np.flatnonzero(last - np.arange(len(key)) >= need[item])
        best: dict[int, int] = {}
        for i in start.tolist():
            found = len(np.unique(entry[i : last[i]]))
            if found >= need[item[i]]:
                best[int(pair[i])] = max(found, best.get(int(pair[i]), 0))
        for k, found in best.items():
            d, i = divmod(k, len(p.ids))
            rows.append(b.lo + d)
            items.append(i)
            share.append(found / p.size[i])
    return np.array(rows, np.int64), np.array(items, np.int64), np.array(share, float)


def _positions(b: Block, h: np.ndarray, at: np.ndarray, wanted: np.ndarray, p: Portion) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of wanted (document, item) pairs: index in ``h``, number of the shingle, pair; by pair and place."""
    doc, item = np.divmod(wanted, len(p.ids))
    first = np.searchsorted(at, b.first)
    size = (first[1:] - first[:-1])[doc]
    out = []
    for lo, hi in _cuts(size, 1 << 21):  # a pair looks at all of its document
        src = ranges(first[doc[lo:hi]], size[lo:hi])
        k = np.repeat(np.arange(lo, hi), size[lo:hi])
        left, right = p.item_head[item[k]], p.item_head[item[k] + 1]
        entry = _search_within(p.by_item, left, right, h[src])
        good = np.flatnonzero((entry < right) & (p.by_item[np.minimum(entry, len(p.by_item) - 1)] == h[src]))
        out.append((src[good], entry[good], wanted[k[good]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _cuts(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def _search_within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """First place between lo and hi, of ascending values, that isn't below x; all at once."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        low = (lo < hi) & (values[np.minimum(mid, len(values) - 1)] < x)
        hi = np.where(low | (lo >= hi), hi, mid)
        lo = np.where(low, mid + 1, lo)
    return lo


def portions(benchmark: DataFrame, item_col: str, text_col: str, n: int, limit: int) -> Iterator[Portion]:
    """The items in portions of at most ``limit`` words (or of one longer item), each fetched as one Arrow table."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            words = pc.add(pc.divide(pc.utf8_length(batch.column(1)), 2), 1).to_pylist()  # no text has more
            cells = []
            for w in words:
                if held and held + w > limit // 4:
                    cell, held = cell + 1, 0
                held += w
                cells.append(cell)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64()), pa.array(words, pa.int64())], names=["id", "text", "cell", "words"])

    dealt = written(rows.mapInArrow(deal, f"id {id_type}, text string, cell long, words long"), "items")
    # as many rows as there are partitions and quarters of a portion
    cells = dealt.groupBy("cell").agg(F.sum("words").alias("words")).orderBy("cell").collect()
    parts, held = [], 0
    for c in cells:
        if not parts or held + c.words > limit:
            parts.append([c.cell, c.cell])
            held = 0
        parts[-1][1] = c.cell
        held += c.words
    for lo, hi in parts:
        table = dealt.where(F.col("cell").between(lo, hi)).select("id", "text").toArrow().combine_chunks()
        yield read_portion(*(table[c].chunk(0) for c in ("id", "text")), n)


def prepared(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, n: int, containment: float, portion: int) -> Iterator[Broadcast]:
    """Portions with their prefixes set by how often their shingles occur in ``docs``, as broadcasts."""
    spark = docs.sparkSession
    for p in portions(benchmark, item_col, item_text_col, n, portion):
        distinct = spark.sparkContext.broadcast(np.unique(p.shingle))

        def count(batches: Iterator[pa.RecordBatch], distinct=distinct) -> Iterator[pa.RecordBatch]:
            table = distinct.value
            total = np.zeros(len(table), np.int64)
            for batch in batches:
                for b in blocks(batch.column(0)):
                    h, _ = b.grams(n)
                    if len(h) and len(table):
                        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                        total += np.bincount(at[table[at] == h], minlength=len(table))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(signed(table[seen])), pa.array(total[seen])], names=["h", "c"])

        freq = docs.select(text_col).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).toArrow()  # at most portion rows
        h = freq["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        set_prefixes(p, h[order], freq["c"].to_numpy()[order], containment)
        yield spark.sparkContext.broadcast(p)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, containment: float = CONTAINMENT, portion: int = PORTION) -> DataFrame:
    """``id_col``, ``item_col`` and ``containment`` of every document and item that it contains."""
    kept = docs.select(id_col, text_col)
    id_type = kept.schema[0].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, containment double"
    out = None
    for shared in prepared(kept, benchmark, text_col, item_col, item_text_col, n, containment, portion):

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, items, share = matches(batch.column(1), shared.value, n, containment)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), shared.value.ids.take(pa.array(items)), pa.array(share)], names=[id_col, item_col, "containment"])

        found = kept.mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, containment: float = CONTAINMENT, portion: int = PORTION) -> DataFrame:
    """The rows of ``docs``, with all columns, that contain no item; decided while scanning, without a join."""
    out = docs
    for shared in prepared(docs, benchmark, text_col, item_col, item_text_col, n, containment, portion):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, _, _ = matches(batch.column(text_col), shared.value, n, containment)
                keep = np.ones(batch.num_rows, bool)
                keep[rows] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


ORACLE = rf"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{SQL_SEPARATOR}'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '{SQL_SEPARATOR}'), lambda x: x <> '') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, len(w) AS words, w[p]||' '||w[p+1]||' '||w[p+2] AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - {N - 2})) AS p FROM iw)),
im AS (SELECT item_id, count(*) AS m FROM ig GROUP BY item_id),
dg AS (SELECT doc_id, p, w[p]||' '||w[p+1]||' '||w[p+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {N - 2})) AS p FROM dw)),
hit AS (SELECT doc_id, item_id, words, p, g FROM dg JOIN ig USING (g)),
busy AS (SELECT doc_id, item_id FROM hit JOIN im USING (item_id) GROUP BY doc_id, item_id, m HAVING count(DISTINCT g) >= {CONTAINMENT} * m - 1e-9),
win AS (SELECT a.doc_id, a.item_id, a.p, count(DISTINCT b.g) AS c
        FROM hit a JOIN busy USING (doc_id, item_id)
        JOIN hit b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p AND a.p + a.words - {N}
        GROUP BY a.doc_id, a.item_id, a.p)
SELECT doc_id, item_id, max(c) / CAST(m AS DOUBLE) AS containment
FROM win JOIN im USING (item_id) GROUP BY doc_id, item_id, m HAVING max(c) >= {CONTAINMENT} * m - 1e-9
"""
