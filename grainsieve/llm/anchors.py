"""Content-defined positions: the smallest n-gram hash of each window of consecutive n-grams.

Of any run of ``window`` n-grams at least one is an anchor, and equal runs have equal anchors,
wherever they stand. So of a passage of ``window + n - 1`` words, every copy has the same anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from grainsieve.llm.words import Block


def sliding(h: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each full window, by doubling."""
    size = 1
    while size < window:
        step = min(size, window - size)
        h = best(h[:-step], h[step:])
        size += step
    return h


def anchors(b: Block, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the anchors of a block, in order."""
    h, at = b.grams(n)
    if len(h) < window:
        return h[:0], at[:0]
    own = b.owner[at]
    low = sliding(h, window, np.minimum)
    low[own[: len(low)] != own[window - 1 :]] = 0
    edge = np.zeros(window - 1, np.uint64)
    chosen = sliding(np.concatenate([edge, low, edge]), window, np.maximum) == h
    return h[chosen], at[chosen]


def decided(batches: Iterator[pa.RecordBatch], key: str, doc: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with, for each row, whether its key has several documents, and whether it's the first of its key; input sorted by both.

    Rows are held back only while all of their key come from one document: a key of any number of rows streams by.
    """
    held, told = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch, held = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0], None
        k, d = batch.column(key).to_numpy(), batch.column(doc).to_numpy()
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        many = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
        first = np.zeros(len(k), bool)
        first[head] = True
        if told is not None and k[0] == told:
            many[0], first[0] = True, False
        end, told = len(k), k[-1] if many[-1] else None
        if told is None:
            end = int(head[-1])
            held = batch.slice(end)
        many = np.repeat(many, np.diff(np.append(head, len(k))))
        if end:
            yield batch.slice(0, end), many[:end], first[:end]
    if held is not None:
        first = np.zeros(held.num_rows, bool)
        first[0] = True
        yield held, np.zeros(held.num_rows, bool), first


def shared_rows(batches: Iterator[pa.RecordBatch], key: str, doc: str) -> Iterator[pa.RecordBatch]:
    """Rows whose key occurs in two documents; input sorted by key and document."""
    for batch, many, _ in decided(batches, key, doc):
        if many.any():
            yield batch.filter(pa.array(many))
