"""SentencePiece encoding and decoding by batched numpy Viterbi (operator 5).

A text is cut into units where no piece of the vocabulary spans two characters that meet there,
so that no token can cross. Each distinct unit is segmented once per worker: units of equal
length advance together; hashes of all substrings probe the sorted keys of the pieces, and at
each end position a vectorised maximum over piece lengths stores a backpointer.

For a unigram model the maximum is of summed scores. For a byte-pair model summed scores would
give other tokens than merging does. There the path must consist of neighbours that merging
leaves apart: a sequence is what merging yields exactly when each of its adjacent pairs is, and
each prefix has exactly one such last token (van Antwerpen and Neubeck, 2024), so the maximum is
over admissible predecessors. Pieces that merging never yields are left out. Characters without
a piece become bytes, or the unknown piece where the model has no bytes.

Empty texts and nulls have no tokens; a null decodes to null. Each row counts by itself, also where
ids are null or repeated; ids may be of any type. Long texts are read whole. An empty table gives an empty
result. Other columns, whatever their names, aren't read.
U+2581 in a text is read as a space, as in the original library. Only models with the identity
normaliser are taken; others raise ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.words import cut, mix, text_buffers

SPACE = 0x2581
PATH = "/opt/tokenizers/piece_bpe_32k.model"
_BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE_UNITS = 2_000_000
NEVER = -1e18


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", data[i : i + n])[0]
            i += n


@dataclass
class Model:
    """Pieces with scores and types (1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte)."""

    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    merges: bool
    prefix: bool

    @staticmethod
    def load(path: str) -> Model:
        with open(path, "rb") as f:
            return Model.parse(f.read())

    @staticmethod
    def parse(data: bytes) -> Model:
        pieces, scores, types, merges, prefix = [], [], [], False, True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(piece.get(2, 0.0))
                types.append(piece.get(3, 1))
            elif field == 2:
                merges = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("only models with the identity normaliser that keep all white space are supported")
                prefix = bool(norm.get(3, 1))
        return Model(pieces, np.array(scores, float), np.array(types), merges, prefix)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of an array of code points."""
    h = np.zeros(codes.shape[0], np.uint64)
    for k in range(codes.shape[1]):
        h = h * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
    return mix(h)


class Tokenizer:
    """Encoder and decoder of a model, with the units seen so far."""

    def __init__(self, model: Model):
        self.model = model
        m = model
        normal = [i for i, t in enumerate(m.types) if t in (1, 4)]
        self.width = max((len(m.pieces[i]) for i in normal), default=1)
        self.byte_id = np.full(256, -1)
        for i in np.flatnonzero(m.types == 6):
            self.byte_id[int(m.pieces[i][1:-1], 16)] = i
        self.unknown = int(np.flatnonzero(m.types == 2)[0])
        table = {m.pieces[i]: i for i in reversed(normal)}
        lone = {p for p in table if p == chr(SPACE) * len(p)}
        # runs of spaces are merged last, by a rule of their own: see _spaces
        self.late_spaces = m.merges and any(len(p) > 1 and m.scores[table[p]] <= -1e9 for p in lone)
        self.space_ids = {len(p): table[p] for p in lone}
        self.table = {p: i for p, i in table.items() if not (self.late_spaces and p in lone and len(p) > 1)}
        if m.merges:
            self._prepare_merges()
        keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_len: dict[int, list[str]] = {}
        for p in self.table:
            by_len.setdefault(len(p), []).append(p)
        for n, ps in by_len.items():
            h = _hashes(np.stack([_codes(p) for p in ps]))
            order = np.argsort(h)
            keys[n] = (h[order], np.array([self.table[p] for p in ps])[order])
        self.keys = keys
        letters = sorted({c for p in table for c in p if len(p) > 1})
        self.slot = np.zeros(0x110000, np.uint16)
        self.slot[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.meets = np.zeros((len(letters) + 1) ** 2, bool)
        for p in table:
            s = self.slot[_codes(p)].astype(np.int64)
            self.meets[s[:-1] * (len(letters) + 1) + s[1:]] = True
        self.letters = len(letters) + 1
        raw = [bytes([int(m.pieces[i][1:-1], 16)]) if m.types[i] == 6 else b"" if m.types[i] in (2, 3) else m.pieces[i].replace(chr(SPACE), " ").encode() for i in range(len(m.pieces))]
        raw[self.unknown] = " ⁇ ".encode()
        self.out_bytes = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
        self.out_start = np.cumsum([0, *map(len, raw)])
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.size_of = np.zeros(0, np.int64)

    # -- byte-pair models ------------------------------------------------------------------

    def _prepare_merges(self) -> None:
        m = self.model
        order = sorted(self.table, key=lambda p: (len(p) > 1, -m.scores[self.table[p]], self.table[p]))
        rank = {p: r for r, p in enumerate(order)}
        halves: dict[tuple[int, int], int] = {}
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = rank.get(p[:k]), rank.get(p[k:])
                if a is not None and b is not None:
                    halves[a, b] = r
        size = len(order)
        left, right, dead = np.arange(size), np.arange(size), []
        for p, r in rank.items():
            if len(p) == 1:
                continue
            got = self._merge(p, rank, halves)
            if got is None:
                dead.append(p)
            else:
                left[r], right[r] = got
        pairs = np.array([a * size + b for a, b in halves], np.int64)
        to = np.array(list(halves.values()), np.int64)
        by = np.argsort(pairs)
        self.pair_key, self.pair_rank, self.left, self.right, self.size = pairs[by], to[by], left, right, size
        self.rank_of = np.full(len(m.pieces), -1, np.int64)
        for p, r in rank.items():
            self.rank_of[self.table[p]] = r
        for p in dead:
            del self.table[p]
        self.apart_key = np.zeros(0, np.int64)
        self.apart_ok = np.zeros(0, bool)

    @staticmethod
    def _merge(p: str, rank: dict, halves: dict) -> tuple[int, int] | None:
        """The last two parts that merging joins into p, or None where it doesn't yield p."""
        if any(c not in rank for c in p):
            return None
        parts = [rank[c] for c in p]
        last = None
        while len(parts) > 1:
            best = min(((halves.get((a, b), 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 40:
                return None
            k = best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [best[0]]
        return last if parts[0] == rank[p] else None

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pair_key):
            return np.full(len(a), 1 << 40)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], 1 << 40)

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b (as ranks) apart: undo their merges, latest first."""
        ok = np.ones(len(a), bool)
        todo, limit = np.arange(len(a)), np.full(len(a), 1 << 39)
        a, b = a.copy(), b.copy()
        while len(todo):
            bad = self._joined(a, b) < limit
            ok[todo[bad]] = False
            todo, a, b, limit = todo[~bad], a[~bad], b[~bad], limit[~bad]
            whole_a, whole_b = self.right[a] == a, self.left[b] == b
            first = ~whole_a & ((a > b) | whole_b)
            second = ~whole_b & ~first
            limit = np.where(first, a, np.where(second, b + 1, limit))
            a, b = np.where(first, self.right[a], a), np.where(second, self.left[b], b)
            go = first | second
            todo, a, b, limit = todo[go], a[go], b[go], limit[go]
        return ok

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stay_apart of piece ids, remembered."""
        key, back = np.unique(self.rank_of[a] * self.size + self.rank_of[b], return_inverse=True)
        at = np.searchsorted(self.apart_key, key)
        new = np.ones(len(key), bool)
        inside = at < len(self.apart_key)
        new[inside] = self.apart_key[at[inside]] != key[inside]
        ok = np.zeros(len(key), bool)
        ok[~new] = self.apart_ok[at[~new]]
        if new.any():
            fresh = key[new]
            ok[new] = self._stay_apart(fresh // self.size, fresh % self.size)
            if len(self.apart_key) > 2_000_000:
                self.apart_key, self.apart_ok = fresh, ok[new]
            else:
                self.apart_key, self.apart_ok = np.insert(self.apart_key, at[new], fresh), np.insert(self.apart_ok, at[new], ok[new])
        return ok[back]

    # -- Viterbi ---------------------------------------------------------------------------

    def _segment(self, codes: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each row; all rows have the same length."""
        n, size = codes.shape
        score = np.full((size + 1, n), NEVER)
        score[0] = 0.0
        last = np.full((size + 1, n), -1, np.int64)
        back = np.zeros((size + 1, n), np.int64)
        for end in range(1, size + 1):
            for length in range(1, min(end, self.width) + 1):
                if length not in self.keys:
                    continue
                key, ids = self.keys[length]
                h = _hashes(codes[:, end - length : end])
                at = np.minimum(np.searchsorted(key, h), len(key) - 1)
                row = np.flatnonzero((key[at] == h) & (score[end - length] > NEVER))
                if not len(row):
                    continue
                piece = ids[at[row]]
                if self.model.merges:
                    before = last[end - length, row]
                    good = before < 0
                    if not good.all():
                        k = np.flatnonzero(~good)
                        good[k] = self._apart(before[k], piece[k])
                    row, piece = row[good], piece[good]
                    value = np.zeros(len(row))
                else:
                    value = score[end - length, row] + self.model.scores[piece]
                better = value > score[end, row]
                row, piece = row[better], piece[better]
                score[end, row], last[end, row], back[end, row] = value[better], piece, length
            lost = np.flatnonzero(score[end] == NEVER)
            if len(lost) and not self.model.merges:
                # a character without a piece: the lowest score less 10, as the original library has it
                value = score[end - 1, lost] + self.model.scores[self.model.types == 1].min() - 10
                score[end, lost], last[end, lost], back[end, lost] = value, self.unknown, 1
        out = []
        rows, pos = np.arange(n), np.full(n, size)
        steps = []
        while (pos > 0).any():
            live = pos > 0
            steps.append(np.where(live, last[pos, rows], -1))
            pos = np.where(live, pos - back[pos, rows], 0)
        path = np.stack(steps[::-1], 1)
        for r in path:
            out.append(r[r >= 0].astype(np.int32))
        return out

    def _unit_ids(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Piece ids of units given by place."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(start)
        size = end - start
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            for lo in range(0, len(at), 1 + 4_000_000 // (int(n) * 8)):
                part = at[lo : lo + 1 + 4_000_000 // (int(n) * 8)]
                codes = text[start[part, None] + np.arange(n)]
                if n == 1:
                    key, ids = self.keys.get(1, (np.zeros(1, np.uint64), np.zeros(1, int)))
                    h = _hashes(codes)
                    k = np.minimum(np.searchsorted(key, h), len(key) - 1)
                    for i, c, ok, piece in zip(part.tolist(), codes[:, 0].tolist(), (key[k] == h).tolist(), ids[k].tolist()):
                        out[i] = np.array([piece] if ok else self._fallback(c), np.int32)
                else:
                    for i, ids in zip(part.tolist(), self._segment(codes)):
                        out[i] = self._late(ids)
        return out

    def _fallback(self, code: int) -> list[int]:
        raw = chr(code).encode("utf-8", "surrogatepass")
        return [int(self.byte_id[b]) for b in raw] if (self.byte_id >= 0).all() else [self.unknown]

    def _late(self, ids: np.ndarray) -> np.ndarray:
        """Merges runs of lone spaces from the left, after all other merges."""
        if not self.late_spaces:
            return ids
        one = self.space_ids[1]
        if (ids == one).sum() < 2:
            return ids
        out: list[int] = []
        run = 0
        most = max(self.space_ids)
        for i in [*ids.tolist(), -1]:
            if i == one:
                run += 1
                continue
            while run:
                k = min(run, most)
                out.append(self.space_ids[k])
                run -= k
            if i >= 0:
                out.append(i)
        return np.array(out, np.int32)

    # -- whole columns ---------------------------------------------------------------------

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and where each text's begin."""
        raw, offsets = text_buffers(column)
        flat, counts = [], []
        for lo, hi in cut(offsets):
            ids, n = self._encode_block(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            flat.append(ids)
            counts.append(n)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), np.append(0, np.cumsum(n))

    def _encode_block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = _codes(raw.tobytes().decode("utf-8", "replace"))
        heads = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets] if len(raw) else np.zeros(len(offsets), np.int64)
        filled = np.flatnonzero(np.diff(heads) > 0)
        if self.model.prefix:
            text = np.insert(text, heads[filled], SPACE)
            heads = heads + np.append(0, np.cumsum(np.diff(heads) > 0))
        text = np.where(text == 32, np.uint32(SPACE), text)
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        slot = self.slot[text].astype(np.int64)
        new = np.ones(len(text), bool)
        new[1:] = ~self.meets[slot[:-1] * self.letters + slot[1:]]
        new[heads[filled]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(text))
        h = self._unit_hash(text, start, end)
        found, at, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, found)
        fresh = np.ones(len(found), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != found[inside]
        if fresh.any():
            if len(self.known) > CACHE_UNITS:
                self.reset()
                fresh[:] = True
                place = np.zeros(len(found), np.int64)
            new_ids = self._unit_ids(text, start[at[fresh]], end[at[fresh]])
            size = np.array([len(x) for x in new_ids], np.int64)
            begin = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, *new_ids])
            where = place[fresh]
            self.known = np.insert(self.known, where, found[fresh])
            self.begin = np.insert(self.begin, where, begin)
            self.size_of = np.insert(self.size_of, where, size)
            place = np.searchsorted(self.known, found)
        unit = place[back]
        n = self.size_of[unit]
        ids = self.flat[_ranges(self.begin[unit], n)]
        total = np.append(0, np.cumsum(n))
        return ids, np.diff(total[np.searchsorted(start, heads)])

    @staticmethod
    def _unit_hash(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        from grainsieve.llm.words import _powers

        power, inverse = _powers(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts end to end, and where each text's begin."""
        size = self.out_start[ids + 1] - self.out_start[ids]
        raw = self.out_bytes[_ranges(self.out_start[ids], size)]
        at = np.append(0, np.cumsum(size))[offsets]
        if not self.model.prefix or not len(raw):
            return raw, at
        filled = np.flatnonzero(np.diff(at) > 0)
        head = at[filled]
        drop = head[raw[head] == 32]
        lost = np.zeros(len(at) - 1, np.int64)
        lost[filled] = raw[head] == 32
        return np.delete(raw, drop), at - np.append(0, np.cumsum(lost))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of ranges, end to end."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size) + np.repeat(start, size)


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a model file, kept in this process."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(Model.load(path))
    return _tokenizers[path]


def encode_documents(docs: DataFrame, *, model_path: str = PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``token_ids``, ``n_tokens`` and ``exact``, whether decoding gives the text back.

    ``model_path`` must be readable on every executor.
    """
    kept = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model_path)
        for batch in batches:
            whole = batch.column(1)
            _, offsets = text_buffers(whole)
            for lo, hi in cut(offsets):
                texts = whole.slice(lo, hi - lo)
                ids, at = tok.encode(texts)
                raw, ends = tok.decode(ids, at)
                source, places = text_buffers(texts)
                exact = np.diff(ends) == np.diff(places)
                same = np.zeros(len(exact), bool)
                if exact.all() and len(raw) == len(source):
                    wrong = np.flatnonzero(raw != source)
                    same[:] = True
                    same[np.searchsorted(places, wrong, "right") - 1] = False
                else:
                    for i in np.flatnonzero(exact):
                        same[i] = np.array_equal(raw[ends[i] : ends[i + 1]], source[places[i] : places[i + 1]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(at).astype(np.int32)), pa.array(same)], names=[id_col, "token_ids", "n_tokens", "exact"])

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, token_ids array<int>, n_tokens int, exact boolean")


def decode_documents(tokens: DataFrame, *, model_path: str = PATH, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``id_col`` and ``text`` of encoded documents; null for null, malformed bytes as U+FFFD. Ids outside the model raise IndexError."""
    kept = tokens.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias(ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model_path)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().fill_null(tok.unknown).to_numpy(zero_copy_only=False)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            raw, at = tok.decode(flat, np.append(0, np.cumsum(size)))
            texts = [raw[x:y].tobytes().decode("utf-8", "replace") if ok else None for x, y, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, text string")
