"""Vectorised word tokens over Arrow string columns.

A word is a maximal run of ASCII letters and digits and of any non-ASCII character,
after lower-casing; everything else separates words. Texts are cut into blocks of whole
documents, so that memory depends on the block size and the longest document and not on
the Arrow batch. Words become 64-bit hashes: polynomial prefix sums modulo 2**64, so that
one pass over the bytes hashes all words of a block together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

#: Splits as ``words`` does, for DuckDB and Spark SQL oracles over ``lower(text)``.
SQL_SEPARATOR = r"[^a-z0-9\x{80}-\x{10ffff}]+"


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), BLOCK_BYTES + 1)
        step = np.full(size, _BASE, np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        _pow, _inv = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return _pow, _inv


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Block:
    """Words of documents ``lo`` to ``hi`` of a batch.

    ``first`` has, for each document, the index of its first word (and one more at the end);
    ``start`` and ``end`` are byte positions in ``raw``, the lower-cased bytes.
    """

    lo: int
    hi: int
    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray
    sums: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans of this block; a whole word's equals its ``code``."""
        return _hash(self.sums, start, end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word runs within documents, and the index of the first word of each."""
        total = len(self.code)
        if total < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rest = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(total)
        at = np.flatnonzero(rest >= n)
        return gram_hash(self.code, at, n), at


def gram_hash(code: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = h * np.uint64(_BASE) + code[at + j]
    return mix(h)


def segments(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes with ``keep`` set, cut at document borders: starts, ends, first run of each document."""
    before, after = np.empty(len(raw), bool), np.empty(len(raw), bool)
    if len(raw):
        before[0], before[1:] = False, keep[:-1]
        after[-1], after[:-1] = False, keep[1:]
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        before[inner], after[inner - 1] = False, False
    start = np.flatnonzero(keep & ~before)
    return start, np.flatnonzero(keep & ~after) + 1, np.searchsorted(start, offsets)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, from which any span's hash follows."""
    power, _ = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    return sums


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def cut(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def blocks(column: pa.Array, *, lower: bool = True, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Word blocks of a string column, in order; nulls are documents without words."""
    column = column.fill_null("")
    raw, offsets = text_buffers(pc.utf8_lower(column) if lower else column)
    for lo, hi in cut(offsets, limit):
        part, off = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        start, end, first = segments(part, off, _WORD[part])
        sums = prefix_sums(part)
        yield Block(lo, hi, part, off, start, end, first, _hash(sums, start, end), sums)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``size`` of them, end to end."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size) + np.repeat(start, size)


def char_of_byte(raw: np.ndarray) -> np.ndarray:
    """For each byte position, and the end, how many characters begin before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
