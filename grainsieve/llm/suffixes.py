"""Repeated passages by a distributed difference-cover suffix array (operator 10).

Which suffixes are sorted: every passage of ``length`` words has an anchor (see ``anchors``) and
each of its copies the same, so only the words around anchors that another document has
can repeat. Where the whole surroundings of an anchor, all that passages with this anchor can
reach, are in several documents, they are passages themselves, and one copy goes on.

Suffixes of what is left are sorted by the difference cover of 3. Three words are packed
into one symbol of the next, shorter text, which holds the positions 1 and 2 modulo 3 of each run
of words; its sampled triples are sorted and named by their order, twice, until symbols stand for
27 words; the last text is sorted by two symbols, deep enough for a passage. On the way back, ranks
of the sampled suffixes order the others, and the three classes are merged, level by level.
All sorts are over ranges of keys; no step gathers a text, a vocabulary or ranks in one
place. In the final order, neighbours whose first ``length`` words agree and that come from different
documents are repeats.

Words are compared by 21 bits of their hash: two passages of 50 words that differ in one word are
taken for equal with a probability of one in two million.

Hot keys: of a passage that many documents of a batch have, all are told at once and one row goes on to the
final sort, so that a key has at most a row a batch there. Keys are named while rows stream by in
their order, which holds no group in memory; ranges of the merges are cut by two symbols.

Results are word positions (words as in ``words``), as in ``substrings``. Documents with null
id, null or empty text and those shorter than ``length`` have no rows. Rows that repeat an id are
one document; repeats within one document don't count. Ids may be of any type. Other columns, whatever
their names, aren't read. An empty table gives an empty result. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.anchors import anchors, decided, shared_rows
from grainsieve.llm.ids import Ids
from grainsieve.llm.jaccard import batches_by_key
from grainsieve.llm.store import discard, written
from grainsieve.llm.words import blocks, mix, ranges, signed

LENGTH = 50
N = 16
BITS = 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


def flat(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all binary rows end to end, and where each row's begin."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw.view(dtype), (off - off[0]) // np.dtype(dtype).itemsize


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary rows of the numbers between offsets."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and index in the row of every number."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - offsets[row]


def ahead(values: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """The numbers k further on in the same row, 0 where it has ended; ``left`` is what follows in the row."""
    out = np.zeros_like(values)
    if k < len(values):
        out[:-k] = values[k:]
    out[left < k] = 0
    return out


def sampled(index: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Place in the next text of a position not divisible by 3: those 1 modulo 3, a gap, those 2 modulo 3."""
    return np.where(index % 3 == 1, index // 3, (size + 1) // 3 + 1 + index // 3)


def window_hash(code: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` numbers from each position on (those past the end count as 0)."""
    h, size = code.astype(np.uint64), 1
    # by doubling: hash of a run and of the run after it
    total, done = np.zeros(len(code), np.uint64), 0
    while done < length:
        if length & size:
            part = np.zeros(len(code), np.uint64)
            part[: max(0, len(code) - done)] = h[done:]
            total = mix(total * _BASE + part)
            done += size
        nxt = np.zeros(len(code), np.uint64)
        nxt[: max(0, len(code) - size)] = h[size:]
        h = mix(h * _BASE + nxt)
        size *= 2
    return total


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one; ``lo`` ascending."""
    top = np.maximum.accumulate(hi)
    new = np.append(True, lo[1:] > top[:-1])
    return lo[new], top[np.append(new[1:], True)]


def spans_by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined spans of each document; input sorted by key and start."""
    for batch in batches_by_key(batches):
        key, lo, hi = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "start", "end"))
        # documents one after the other on one axis
        doc = np.cumsum(np.append(0, key[1:] != key[:-1]))
        stride = int(hi.max()) + 2
        a, b = merge_spans(lo + doc * stride, hi + doc * stride)
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        d = a // stride
        yield pa.RecordBatch.from_arrays([pa.array(key[first[d]]), pa.array((a - d * stride).astype(np.int32)), pa.array((b - d * stride).astype(np.int32))], names=["id", "start", "end"])


def candidates(docs: DataFrame, length: int) -> DataFrame:
    """(id, start, code, at): runs of words that surround shared anchors, and the anchors in each."""
    window, reach = length - N + 1, length - N

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, at = anchors(b, N, window)
                doc = np.searchsorted(b.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), batch.column(0).take(pa.array(b.lo + doc)), pa.array((at - b.first[doc]).astype(np.int32))], names=["key", "id", "pos"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared_rows(batches, "key", "id"):
            yield batch.select(["id", "pos"])

    found = docs.mapInArrow(begin, "key long, id long, pos int").repartition("key").sortWithinPartitions("key", "id").mapInArrow(shared, "id long, pos int")
    sides = found.groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("at"))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(1)):
                doc = np.repeat(np.arange(b.hi - b.lo), np.diff(off[b.lo : b.hi + 1]))
                at = values[off[b.lo] : off[b.hi]] + b.first[doc]
                # rows that repeat an id with another text may lack a position
                ok = at + N <= b.first[doc + 1]
                doc, at = doc[ok], at[ok]
                lo, hi = np.maximum(at - reach, b.first[doc]), np.minimum(at + length, b.first[doc + 1])
                whole = hi - lo >= length
                doc, at, lo, hi = doc[whole], at[whole], lo[whole], hi[whole]
                if not len(at):
                    continue
                new = np.append(True, (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (doc[1:] != doc[:-1]))
                run = np.cumsum(new) - 1
                start, end = lo[new], hi[np.append(new[1:], True)]
                take = ranges(start, end - start)
                code = (b.code[take] >> np.uint64(64 - BITS)).astype(np.uint32) + np.uint32(1)
                code = np.minimum(code, np.uint32((1 << BITS) - 1))  # 0 stands for the end
                heads = np.append(np.flatnonzero(new), len(at))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(b.lo + doc[new])),
                    pa.array((start - b.first[doc[new]]).astype(np.int32)),
                    packed(code, np.append(0, np.cumsum(end - start))),
                    packed((at - start[run]).astype(np.int32), heads),
                ], names=["id", "start", "code", "at"])

    rows = docs.join(sides.hint("merge"), "id").select("id", "text", "at")
    return rows.mapInArrow(surround, "id long, start int, code binary, at binary")


def surroundings(found: DataFrame, length: int) -> DataFrame:
    """(id, start, end, many, on): surroundings of anchors, whether several documents have them, and whether they are to be sorted."""
    reach = length - N

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, off = flat(batch.column(2), np.uint32)
            at, heads = flat(batch.column(3), np.int32)
            row = np.repeat(np.arange(batch.num_rows), np.diff(heads))
            size = np.diff(off)[row]
            lo, hi = np.maximum(at - reach, 0).astype(np.int64), np.minimum(at + length, size)
            # a hash of the words between two ends, from prefix sums of a polynomial
            h = span_hash(code, off[row] + lo, off[row] + hi)
            first = batch.column(1).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), batch.column(0).take(pa.array(row)), pa.array((first + lo).astype(np.int32)), pa.array((first + hi).astype(np.int32))], names=["key", "id", "start", "end"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, many, first in decided(batches, "key", "id"):
            on = ~many | first
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), batch.column("end"), pa.array(many), pa.array(on)], names=["id", "start", "end", "many", "on"])

    rows = found.mapInArrow(contexts, "key long, id long, start int, end int")
    return rows.repartition("key").sortWithinPartitions("key", "id", "start").mapInArrow(judge, "id long, start int, end int, many boolean, on boolean")


def span_hash(code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    from grainsieve.llm.words import _powers

    power, inverse = _powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code.astype(np.uint64)) * power[: len(code)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def text_runs(found: DataFrame, around: DataFrame, length: int) -> DataFrame:
    """(rid, id, start, code, known): the runs of words to be sorted; ``known`` marks positions of passages already found."""
    lists = around.where("on").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "many"))).alias("spans"))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, off = flat(batch.column(2), np.uint32)
            lists = batch.column(3)
            lo_off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
            lo, hi, many = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(lo_off))
            pick = slice(lo_off[0], lo_off[-1])
            first = batch.column(1).to_numpy().astype(np.int64)[row]
            lo, hi, many = lo[pick] - first, hi[pick] - first, many[pick]
            inside = (lo >= 0) & (hi <= np.diff(off)[row])
            row, lo, hi, many = row[inside], lo[inside] + off[row[inside]], hi[inside] + off[row[inside]], many[inside]
            if not len(row):
                continue
            edge, told = np.zeros(len(code) + 1, np.int64), np.zeros(len(code) + 1, np.int64)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
            np.add.at(told, lo[many], 1)
            np.add.at(told, np.maximum(lo[many], hi[many] - length + 1), -1)
            keep, known = np.cumsum(edge[:-1]) > 0, np.cumsum(told[:-1]) > 0
            head = keep.copy()
            head[1:] &= ~keep[:-1]
            begins = np.zeros(len(code), bool)
            begins[off[:-1][np.diff(off) > 0]] = True
            head |= keep & begins
            where = np.flatnonzero(head)
            size = np.add.reduceat(keep, where) if len(where) else np.zeros(0, np.int64)
            own = np.searchsorted(off, where, "right") - 1
            offsets = np.append(0, np.cumsum(size))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array((batch.column(1).to_numpy()[own] + where - off[own]).astype(np.int32)), packed(code[keep], offsets), packed(known[keep].astype(np.uint8), offsets)], names=["id", "start", "code", "known"])

    rows = found.select("id", "start", "code").join(lists.hint("merge"), "id").mapInArrow(select, "id long, start int, code binary, known binary")
    return rows.dropDuplicates(["id", "start", "code"]).select(F.monotonically_increasing_id().alias("rid"), "id", "start", "code", "known")


def triples(code: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Three words from each position as one number, in the order of the words."""
    row, index = places(off)
    left = np.diff(off)[row] - index - 1
    c = code.astype(np.uint64)
    return c << np.uint64(2 * BITS) | ahead(c, left, 1) << np.uint64(BITS) | ahead(c, left, 2)


def first_text(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of packed triples at the sampled positions of each run, and where each run's begins."""
    size = np.diff(off)
    key = triples(code, off)
    row, index = places(off)
    new_size = (size + 1) // 3 + np.where(size > 2, 1 + size // 3, 0)
    new_off = np.append(0, np.cumsum(new_size))
    out = np.zeros(new_off[-1], np.uint64)
    use = index % 3 != 0
    out[new_off[row[use]] + sampled(index[use], size[row[use]])] = key[use]
    return out, new_off


def whole_partition(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    return [c.to_numpy() for c in table.columns]


def _number() -> int:
    return TaskContext.get().partitionId() << 40


def _out(rid: np.ndarray, idx: np.ndarray, name: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rid), 1 << 17):
        s = slice(lo, lo + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(rid[s]), pa.array(idx[s]), pa.array(name[s])], names=["key", "idx", "name"])


def name_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the keys of a range, in their order; input (a, b, c, rid, idx) or (a, b, rid, idx), sorted by the keys."""
    name, last = _number(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        *keys, rid, idx = (c.to_numpy() for c in batch.columns)
        new = np.zeros(len(rid), np.int64)
        new[0] = last is None or any(k[0] != x for k, x in zip(keys, last))
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        names = np.cumsum(new) + name
        name, last = int(names[-1]), [k[-1] for k in keys]
        yield from _out(rid, idx, names)


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of names for each run; input sorted by key and idx; what is missing between is 0."""
    for batch in batches_by_key(batches):
        key, idx, name = batch.column("key").to_numpy(), batch.column("idx").to_numpy().astype(np.int64), batch.column("name").to_numpy()
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(head[1:], len(key)) - 1
        off = np.append(0, np.cumsum(idx[last] + 1))
        out = np.zeros(off[-1], np.int64)
        out[np.repeat(off[:-1], np.diff(np.append(head, len(key)))) + idx] = name
        yield pa.RecordBatch.from_arrays([pa.array(key[head]), packed(out, off)], names=["rid", "sym"])


def by_run(named: DataFrame, name: str) -> DataFrame:
    return written(named.repartition("key").sortWithinPartitions("key", "idx").mapInArrow(pack_rows, "rid long, sym binary"), name)


def next_text(text: DataFrame, name: str, packed_words: bool) -> DataFrame:
    """Sorted names of the sampled triples of a text, as the next text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sym, off = flat(batch.column(1), np.uint32 if packed_words else np.int64)
            if packed_words:
                sym, off = first_text(sym, off)
            row, index = places(off)
            size = np.diff(off)[row]
            left = size - index - 1
            use = index % 3 != 0
            keys = [sym[use], ahead(sym, left, 1)[use], ahead(sym, left, 2)[use]]
            yield pa.RecordBatch.from_arrays([*(pa.array(k.astype(np.int64)) for k in keys), batch.column(0).take(pa.array(row[use])), pa.array(sampled(index, size)[use].astype(np.int32))], names=["a", "b", "c", "rid", "idx"])

    rows = text.mapInArrow(emit, "a long, b long, c long, rid long, idx int")
    return by_run(rows.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(name_keys, "key long, idx int, name long"), name)


def last_ranks(text: DataFrame, name: str) -> DataFrame:
    """Ranks of all suffixes of the last text, by two symbols."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sym, off = flat(batch.column(1), np.int64)
            row, index = places(off)
            yield pa.RecordBatch.from_arrays([pa.array(sym), pa.array(ahead(sym, np.diff(off)[row] - index - 1, 1)), batch.column(0).take(pa.array(row)), pa.array(index.astype(np.int32))], names=["a", "b", "rid", "idx"])

    rows = text.mapInArrow(emit, "a long, b long, rid long, idx int")
    return by_run(rows.repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(name_keys, "key long, idx int, name long"), name)


def suffix_keys(sym: np.ndarray, off: np.ndarray, rank: np.ndarray, rank_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, second symbol and two ranks of each suffix; ``rank`` has those of the sampled ones.

    Class 0 has the ranks one and two positions on, class 1 its own and that one on, class 2 its own and that two on.
    """
    row, index = places(off)
    size = np.diff(off)[row]
    at_rank = np.zeros(len(sym), np.int64)
    use = index % 3 != 0
    at_rank[use] = rank[rank_off[row[use]] + sampled(index[use], size[use])]
    left = size - index - 1
    one, two = ahead(at_rank, left, 1), ahead(at_rank, left, 2)
    kind = index % 3
    return kind.astype(np.int8), ahead(sym, left, 1), np.where(kind == 0, one, at_rank), np.where(kind == 1, one, two)


def merged_order(a: np.ndarray, b: np.ndarray, kind: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """The order of suffixes by symbols and ranks: each class is sorted, its place among the others counted."""
    c0, c1, c2 = (np.flatnonzero(kind == k) for k in range(3))
    place = np.zeros(len(a), np.int64)

    def count(x: np.ndarray, y: np.ndarray, keys: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Adds to each place how many of the other class come before; returns x in order."""
        both = np.concatenate([x, y])
        order = np.lexsort([np.concatenate([p, q]) for p, q in reversed(keys)])
        second = order >= len(x)
        place[both[order[~second]]] += np.cumsum(second)[~second]
        place[both[order[second]]] += np.cumsum(~second)[second]
        return both[order[~second]]

    place[count(c0, c1, [(a[c0], a[c1]), (ra[c0], rb[c1])])] += np.arange(len(c0))
    count(c0, c2, [(a[c0], a[c2]), (b[c0], b[c2]), (rb[c0], rb[c2])])
    both = np.concatenate([c1, c2])
    order = np.lexsort((ra[both], a[both]))
    place[both[order]] += np.arange(len(both))
    return np.argsort(place, kind="stable")


def merge_ranks(text: DataFrame, ranks: DataFrame, name: str, packed_words: bool) -> DataFrame:
    """Ranks of all suffixes of a text, from those of its sampled suffixes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sym, off = flat(batch.column(1), np.uint32 if packed_words else np.int64)
            if packed_words:
                sym, off = first_text(sym, off)
                sym = sym.astype(np.int64)
            kind, second, ra, rb = suffix_keys(sym, off, *flat(batch.column(2), np.int64))
            row, index = places(off)
            yield pa.RecordBatch.from_arrays([pa.array(sym), pa.array(second), pa.array(kind), pa.array(ra), pa.array(rb), batch.column(0).take(pa.array(row)), pa.array(index.astype(np.int32))], names=["a", "b", "kind", "ra", "rb", "rid", "idx"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = whole_partition(batches)
        if columns is not None:
            at = merged_order(*columns[:5])
            yield from _out(columns[5][at], columns[6][at], np.arange(1, len(at) + 1) + _number())

    both = text.join(ranks.select("rid", F.col("sym").alias("rank")).hint("merge"), "rid")
    rows = both.mapInArrow(emit, "a long, b long, kind byte, ra long, rb long, rid long, idx int")
    return by_run(rows.repartitionByRange("a", "b").mapInArrow(order, "key long, idx int, name long"), name)


def one_for_many(prefix: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows go on, and which of them stand for several documents with the same prefix."""
    on, told = np.ones(len(prefix), bool), np.zeros(len(prefix), bool)
    if len(prefix):
        order = np.argsort(prefix, kind="stable")
        p, d = prefix[order], doc[order]
        head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        many = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
        on[order] = ~np.repeat(many, np.diff(np.append(head, len(p))))
        on[order[head[many]]] = told[order[head[many]]] = True
    return on, told


def _spans(doc: np.ndarray, start: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Passages of ``length`` words, overlapping ones as one."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    for lo in range(0, len(first), 1 << 17):
        f, t = first[lo : lo + (1 << 17)], last[lo : lo + (1 << 17)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[f]), pa.array(start[f].astype(np.int32)), pa.array((start[t] + length).astype(np.int32))], names=["key", "start", "end"])


def final_repeats(runs: DataFrame, ranks: DataFrame, length: int) -> DataFrame:
    """(key, start, end): passages of ``length`` words that neighbours of another document share in the order of all suffixes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, off = flat(batch.column(3), np.uint32)
            kind, _, ra, rb = suffix_keys(code, off, *flat(batch.column(5), np.int64))
            row, index = places(off)
            whole = np.diff(off)[row] - index >= length  # shorter ones can't begin a passage
            known = flat(batch.column(4), np.uint8)[0]
            start = batch.column(2).to_numpy()[row] + index
            w = np.flatnonzero(whole)
            prefix, doc = signed(window_hash(code, length))[w], batch.column(1).to_numpy()[row[w]]
            on, told = one_for_many(prefix, doc)
            mark = kind[w] + 4 * (known[w].astype(np.int8) | told)
            # those that stay behind are results; any range of the sort takes them
            three = triples(code, off).astype(np.int64)
            a = np.where(on, three[w], np.random.default_rng(len(w)).integers(0, 1 << 62, len(w)))
            b = np.where(on, ahead(three, np.diff(off)[row] - index - 1, 3)[w], 0)
            columns = [a, b, np.where(on, mark, 8).astype(np.int8), *(np.where(on, x, 0) for x in (ra[w], rb[w], prefix)), doc, start[w].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "kind", "ra", "rb", "prefix", "id", "start"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = whole_partition(batches)
        if columns is None:
            return
        done = columns[2] == 8
        if done.any():
            yield from _spans(columns[6][done], columns[7][done].astype(np.int64), length)
        a, _, kind, ra, rb, prefix, doc, start = (c[~done] for c in columns)
        if not len(a):
            return
        order = merged_order(a, np.zeros(len(a), np.int64), kind & 3, ra, rb)
        prefix, doc, start, known = prefix[order], doc[order], start[order], (kind[order] & 4) > 0
        head = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        hit = np.logical_or.reduceat(known, head) | (np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head))
        hit = np.repeat(hit, np.diff(np.append(head, len(doc))))
        yield from _spans(doc[hit], start[hit].astype(np.int64), length)

    both = runs.select("rid", "id", "start", "code", "known").join(ranks.select("rid", F.col("sym").alias("rank")).hint("merge"), "rid")
    rows = both.mapInArrow(emit, "a long, b long, kind byte, ra long, rb long, prefix long, id long, start int")
    return rows.repartitionByRange("a", "b").mapInArrow(compare, "key long, start int, end int")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id_col``, ``start_word`` and ``end_word`` (exclusive) of all passages of at least ``length`` words that another document has too."""
    if not N <= length <= 54:
        raise ValueError(f"length must be from {N} to 54")
    spark, number = docs.sparkSession, Ids(docs, id_col)
    kept = number.rows(docs, F.col(f"`{text_col}`").alias("text"))
    found = written(candidates(kept, length), "candidates")
    around = written(surroundings(found, length), "surroundings")
    runs = written(text_runs(found, around, length), "runs")
    discard(spark, found)
    direct = written(around.where("many").select(F.col("id").alias("key"), "start", "end"), "direct")
    discard(spark, around)
    words = runs.select("rid", "code")
    second = next_text(words, "names9", True)
    third = next_text(second, "names27", False)
    rank3 = last_ranks(third, "ranks27")
    discard(spark, third)
    rank2 = merge_ranks(second, rank3, "ranks9", False)
    discard(spark, second, rank3)
    rank1 = merge_ranks(words, rank2, "ranks3", True)
    discard(spark, rank2)
    spans = final_repeats(runs, rank1, length).unionByName(direct)
    out = spans.repartition("key").sortWithinPartitions("key", "start").mapInArrow(spans_by_id, "id long, start int, end int")
    out = out.select("id", F.col("start").alias("start_word"), F.col("end").alias("end_word"))
    return number.back(out, id=id_col)
