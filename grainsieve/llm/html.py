"""HTML main text by a suffix array per host (operator 3).

Pages become streams of words: scripts, styles, comments, titles and tags go, entities are
decoded. The streams of a host are concatenated and their suffixes sorted, range by range of the first
word, to the depth of ``length`` words, which is all that decides whether a substring of that length is
repeated. Where neighbours in the order agree on ``length`` words and lie on distinct pages, those
words are boilerplate; what no such substring covers is kept, as runs of words, one a line.

A host whose pages together are longer than ``host_bytes`` isn't gathered in one task: its texts are
written, each with a row number, and its suffixes are partitioned by host and hash of their first ``length``
words and sorted there, as (hash, page) rows that stream by. The result is the same.

Pages with the same id count as one page, so that repeated rows aren't each other's boilerplate;
rows with a null id are pages of their own. Ids may be of any type. Null or empty HTML gives an empty text,
long pages are read whole. Pages whose URL is null or has no host share the empty host. An empty
table gives an empty result. Every row gives one; columns other than these three, whatever their names, aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.jaccard import runs
from grainsieve.llm.store import written
from grainsieve.llm.words import _hash, gram_hash, mix, prefix_sums, segments, signed, text_buffers

LENGTH = 6
HOST_BYTES = 256 << 20
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*(?:>|\Z)")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def page_text(html: str | None) -> str:
    """Words of a page, separated by single spaces."""
    return " ".join(unescape(_TAG.sub(" ", _DROP.sub(" ", html or ""))).split())


def word_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, start and end of all words, the first word of each text, and the bytes."""
    raw, offsets = text_buffers(texts)
    start, end, first = segments(raw, offsets, ~_BLANK[raw])
    code = np.empty(len(start), np.uint64)
    # prefix sums by portions: their powers needn't reach over all of a host
    for lo in range(0, len(start), 1 << 18):
        s, e = start[lo : lo + (1 << 18)], end[lo : lo + (1 << 18)]
        code[lo : lo + (1 << 18)] = _hash(prefix_sums(raw[s[0] : e[-1]]), s - s[0], e - s[0])
    return code, start, end, first, raw


def repeated(code: np.ndarray, first: np.ndarray, page: np.ndarray, length: int, portion: int = 1 << 20) -> np.ndarray:
    """Which words lie in a substring of ``length`` words that is repeated on distinct pages.

    ``first`` has the first word of each text, and the end; ``page`` each text's page. A substring lies within one
    text. The suffix array is made by ranges of the first word, of about ``portion`` suffixes, and to
    the depth that matters.
    """
    n = len(code)
    edge = np.zeros(n + 1, np.int32)
    if n < length:
        return edge[:-1] > 0
    known = np.unique(code)
    rank = np.empty(n, np.int32)
    for lo in range(0, n, portion):
        rank[lo : lo + portion] = np.searchsorted(known, code[lo : lo + portion])
    upto = np.cumsum(np.bincount(rank, minlength=len(known)))
    lo = 0
    while lo < len(known):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + portion, "right")))
        at = np.flatnonzero((rank >= lo) & (rank < hi))
        lo = hi
        text = np.searchsorted(first, at, "right") - 1
        whole = at + length <= first[text + 1]
        at, text = at[whole], text[whole]
        if len(at) < 2:
            continue
        pairs = [rank[at + k].astype(np.int64) << 32 | (rank[at + k + 1] if k + 1 < length else 0) for k in range(0, length, 2)]
        order = np.lexsort(pairs[::-1])
        new = np.append(True, np.zeros(len(at) - 1, bool))
        for k in pairs:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        head = np.flatnonzero(new)
        own = page[text[order]]
        several = np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head)
        hit = at[order[np.repeat(several, np.diff(np.append(head, len(at))))]]
        edge[hit] += 1
        edge[hit + length] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def kept_runs(text: bytes, start: np.ndarray, end: np.ndarray, covered: np.ndarray) -> tuple[str, int]:
    """The words of a page that aren't covered, a line for each run, and the number of runs."""
    free = ~covered
    begin = np.flatnonzero(free & ~np.append(False, free[:-1]))
    stop = np.flatnonzero(free & ~np.append(free[1:], False))
    lines = [text[s:e].decode("utf-8", "replace") for s, e in zip(start[begin].tolist(), end[stop].tolist())]
    return "\n".join(lines), len(lines)


def _emit(ids: pa.Array, hosts: pa.Array, texts: pa.Array, covered: np.ndarray) -> pa.RecordBatch:
    _, start, end, first, raw = word_stream(texts)
    out, n_runs = [], []
    data = raw.tobytes()
    for a, b in zip(first[:-1], first[1:]):
        text, k = kept_runs(data, start[a:b], end[a:b], covered[a:b])
        out.append(text)
        n_runs.append(k)
    total = np.append(0, np.cumsum(covered))[first]
    removed = np.diff(total)
    return pa.RecordBatch.from_arrays([ids, hosts, pa.array(out, pa.string()), pa.array(n_runs, pa.int32()), pa.array((np.diff(first) - removed).astype(np.int32)), pa.array(removed.astype(np.int32))], names=["id", "host", "text", "runs", "kept_words", "removed_words"])


def host_pages(group: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """The pages of a host without its boilerplate; texts are read in portions, twice."""
    parts = group.to_batches(max_chunksize=1000)
    codes, sizes = [], []
    for p in parts:
        code, _, _, first, _ = word_stream(p.column("text"))
        codes.append(code)
        sizes.append(np.diff(first))
    first = np.append(0, np.cumsum(np.concatenate(sizes)))
    ids = pa.concat_arrays([p.column("id") for p in parts])
    number = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    page = np.where(np.isnan(number), len(ids) + np.arange(len(ids)), np.nan_to_num(number)).astype(np.int64)
    covered = repeated(np.concatenate(codes), first, page, length)
    del codes
    row = 0
    for p in parts:
        yield _emit(p.column("id"), p.column("host"), p.column("text"), covered[first[row] : first[row + p.num_rows]])
        row += p.num_rows


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", length: int = LENGTH, host_bytes: int = HOST_BYTES) -> DataFrame:
    """``id_col``, ``host``, ``text`` (kept runs), ``runs``, ``kept_words`` and ``removed_words`` of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), F.col(f"`{html_col}`").alias("html"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, host string, text string, runs int, kept_words int, removed_words int"
    huge = pages.select(host.alias("host"), F.length(html_col).alias("n")).groupBy("host").agg(F.sum("n").alias("n")).where(F.col("n") > host_bytes).select("host")
    names = [r.host for r in huge.collect()]  # fewer than the data's size over host_bytes

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = pa.array([page_text(h) for h in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["id", "host", "text"])

    def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "host"):
            yield from host_pages(group, length)

    texts = rows.mapInArrow(extract, f"id {id_type}, host string, text string")
    usual = texts.where(~F.col("host").isin(names)) if names else texts
    out = usual.repartition("host").sortWithinPartitions("host").mapInArrow(by_host, schema)
    if names:
        out = out.unionByName(_spread(texts.where(F.col("host").isin(names)), length, schema))
    return out.withColumnRenamed("id", id_col)


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (key, page) rows whose key has several pages; input sorted by both. Holds one row at a time."""
    last = first = told = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, p = batch.column("key").to_numpy(), batch.column("page").to_numpy()
        fresh = np.append((k[0], p[0]) != last, (k[1:] != k[:-1]) | (p[1:] != p[:-1]))
        last = (k[-1], p[-1])
        k, p = k[fresh], p[fresh]
        if not len(k):
            continue
        if first is not None and first[0] == k[0]:
            k, p = np.append(first[0], k), np.append(first[1], p)
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(head, len(k)))
        many = (size > 1) | (k[head] == told if told is not None else False)
        first, told = (None, k[-1]) if many[-1] else ((k[-1], p[-1]), None)
        on = np.repeat(many, size)
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[on]), pa.array(p[on])], names=["key", "page"])


def _spread(texts: DataFrame, length: int, schema: str) -> DataFrame:
    """The same for hosts of any size: suffixes partitioned by their first words."""
    # written, so that the suffixes and the join back see the same row numbers
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "pages")
    page = F.when(F.col("id").isNull(), F.xxhash64("row", F.lit("null"))).otherwise(F.xxhash64("id", F.lit("id"), "host"))
    texts = texts.withColumn("site", F.xxhash64("host")).withColumn("page", page)

    def keys_of(site: int, code: np.ndarray) -> np.ndarray:
        at = np.arange(len(code) - length + 1)
        return mix(gram_hash(code, at, length) + np.uint64(site & (1 << 64) - 1))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                code, _, _, first, _ = word_stream(part.column(0))
                out_k, out_p = [], []
                for site, own, a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), first[:-1], first[1:]):
                    if b - a >= length:
                        out_k.append(np.unique(keys_of(site, code[a:b])))
                        out_p.append(np.full(len(out_k[-1]), own, np.int64))
                if out_k:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(out_k))), pa.array(np.concatenate(out_p))], names=["key", "page"])

    grams = texts.select("text", "site", "page").mapInArrow(suffixes, "key long, page long")
    shared = grams.repartition("key").sortWithinPartitions("key", "page").mapInArrow(shared_keys, "key long, page long")
    found = written(shared, "repeats").groupBy("page").agg(F.collect_list("key").alias("keys"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                code, _, _, first, _ = word_stream(part.column(2))
                covered = np.zeros(len(code), bool)
                known = part.column(4)[0].values
                if known is not None and len(code) >= length:
                    known = known.to_numpy().view(np.uint64)
                    hit = np.flatnonzero(np.isin(keys_of(part.column(3)[0].as_py(), code), known))
                    for j in range(length):
                        covered[hit + j] = True
                yield _emit(part.column(0), part.column(1), part.column(2), covered)

    return texts.join(found, "page", "left").select("id", "host", "text", "site", "keys").mapInArrow(finish, schema)
