"""Toxic spans by a linear-chain conditional random field (operator 6).

Two states, clean and toxic. A word's evidence for the toxic state is a sum of hashed
weights of the word, its beginnings and its ending; transitions join neighbours. Documents
are labelled, words are not: a word of a toxic document counts as labelled toxic where one
of its features is much more frequent in toxic documents than in clean ones, and hardly by chance. Chains are
sentences, cut after ``CHAIN`` words. Forward-backward gives each word's marginal; a
document's score is its largest marginal, its offending spans are the runs of words whose
marginal reaches the threshold, as character offsets into the text.

Nulls and empty texts have no words, hence score 0 and no span. Texts of any length are
read whole. Rows are scored one by one, so repeated rows give repeated results. Without a
toxic or a clean labelled document no model can be fitted: scores are then all 0. A label counts where it is 0 or 1
and has an id; an id labelled both ways is toxic; of documents that repeat a labelled id the smallest text
is learnt from. Ids may be of any type, null ids are scored like others. An empty table gives an empty
result. ``keep_clean`` returns all columns as they are, whatever their names; the other functions read id and text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.words import Block, blocks, char_of_byte, mix

BITS = 20
CHAIN = 64
SAMPLE = 1000
THRESHOLD = 0.8
SURPRISE = float(np.log(1e5))
TAG_BYTES = 1 << 19  # of text that is scored at a time
SCHEMA = "score double, spans array<struct<start:int,end:int>>"


@dataclass
class Crf:
    """``weight`` of hashed features, ``bias``, and transition scores [from, to]."""

    weight: np.ndarray
    bias: float
    trans: np.ndarray


def features(b: Block) -> np.ndarray:
    """Feature slots of each word: itself, its first 4, 5 and 6 bytes, its last 4."""
    size = b.end - b.start
    spans = [b.code]
    for salt, n in ((1, 4), (2, 5), (3, 6)):
        h = b.hash_of(b.start, b.start + np.minimum(n, size))
        spans.append(h * np.uint64(2 * salt + 1) + np.uint64(salt))
    spans.append(b.hash_of(b.end - np.minimum(4, size), b.end) * np.uint64(9) + np.uint64(4))
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in spans])


def chains(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each chain."""
    n = len(b.code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stops = np.zeros(len(b.raw) + 1, np.int64)
    np.cumsum((b.raw == 46) | (b.raw == 33) | (b.raw == 63) | (b.raw == 10), out=stops[1:])
    new = np.ones(n, bool)
    new[1:] = stops[b.start[1:]] > stops[b.end[:-1]]
    new[b.first[:-1][np.diff(b.first) > 0]] = True
    head = np.flatnonzero(new)
    inside = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
    head = np.flatnonzero(inside % CHAIN == 0)
    return head, np.diff(np.append(head, n))


def marginals(s: np.ndarray, head: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic marginal of each word, and the expected number of each transition.

    All chains advance together, longest first, so that step t works on a prefix of them.
    """
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    n = len(s)
    e = np.exp(np.clip(s, -30, 30))
    t = np.exp(trans)
    a, b = np.ones((2, n)), np.ones((2, n))
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    for k, m in enumerate(alive):
        at = head[:m] + k
        if k:
            p0, p1 = a[0, at - 1], a[1, at - 1]
            x0, x1 = p0 * t[0, 0] + p1 * t[1, 0], (p0 * t[0, 1] + p1 * t[1, 1]) * e[at]
        else:
            x0, x1 = np.ones(m), e[at]
        z = x0 + x1
        a[0, at], a[1, at] = x0 / z, x1 / z
    for k in range(len(alive) - 2, -1, -1):
        at = head[: alive[k + 1]] + k
        n0, n1 = b[0, at + 1], b[1, at + 1] * e[at + 1]
        x0, x1 = t[0, 0] * n0 + t[0, 1] * n1, t[1, 0] * n0 + t[1, 1] * n1
        z = x0 + x1
        b[0, at], b[1, at] = x0 / z, x1 / z
    p = a * b
    first = np.zeros(n, bool)
    first[head] = True
    right = np.flatnonzero(~first)
    pair = a[:, None, right - 1] * t[:, :, None] * (np.stack([np.ones(len(right)), e[right]]) * b[:, right])[None]
    pair /= np.maximum(pair.sum((0, 1)), 1e-300)
    return p[1] / np.maximum(p.sum(0), 1e-300), pair.sum(2)


def distinct(texts: list[str | None]) -> list[int]:
    """Documents that share none of four min-hashes of word triples with an earlier one.

    Copies of one toxic document would make all its words look toxic.
    """
    taken: set[tuple[int, int]] = set()
    keep = []
    for b in blocks(pa.array(texts, pa.string())):
        h, at = b.grams(3)
        own = b.owner[at]
        head = np.searchsorted(own, np.arange(b.hi - b.lo + 1))
        full = np.flatnonzero(np.diff(head) > 0)
        low = np.array([np.minimum.reduceat(mix(h + np.uint64(k)), head[full]) for k in range(4)]) if len(full) else np.zeros((4, 0))
        sketch = {int(d): [(k, int(low[k, j])) for k in range(4)] for j, d in enumerate(full)}
        for d in range(b.hi - b.lo):
            own_sketch = sketch.get(d, [(4, hash(tuple(b.code[b.first[d] : b.first[d + 1]].tolist())))])
            if not taken.intersection(own_sketch):
                keep.append(b.lo + d)
            taken.update(own_sketch)
    return keep


def surprise(k: np.ndarray, m: np.ndarray, share: float) -> np.ndarray:
    """Chernoff's bound on how improbable k toxic documents of m are by chance, as a negative logarithm."""
    p = np.clip(k / np.maximum(m, 1), 1e-9, 1 - 1e-9)
    return np.where(p > share, m * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share))), 0)


def fit(texts: list[str | None], toxic: list[int], steps: int = 40, ratio: float = 3.0, support: float = 0.02) -> Crf | None:
    """A model of labelled documents; None where one of the classes is missing."""
    alone = distinct(texts)
    texts, y = [texts[i] for i in alone], np.array(toxic, bool)[alone]
    if not len(y) or y.all() or not y.any():
        return None
    parts = [(b, features(b)) for b in blocks(pa.array(texts, pa.string()))]
    seen = np.zeros((2, 1 << BITS))
    for b, f in parts:
        own = b.owner
        for row in f:
            pair = np.unique(own * (1 << BITS) + row)
            np.add.at(seen, (y[b.lo + pair // (1 << BITS)].astype(int), pair % (1 << BITS)), 1)
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((~y).sum() + 1))
    marked = (odds >= ratio) & (seen[1] >= max(3, support * y.sum())) & (surprise(seen[1], seen.sum(0), y.mean()) >= SURPRISE)
    slots, gold, heads, sizes, base = [], [], [], [], 0
    for b, f in parts:
        head, size = chains(b)
        slots.append(f)
        gold.append(marked[f].any(0) & y[b.lo + b.owner])
        heads.append(head + base)
        sizes.append(size)
        base += len(b.code)
    f, g, head, size = np.concatenate(slots, 1), np.concatenate(gold).astype(float), np.concatenate(heads), np.concatenate(sizes)
    first = np.zeros(base, bool)
    first[head] = True
    right = np.flatnonzero(~first)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (g[right - 1].astype(int), g[right].astype(int)), 1)
    m = Crf(np.zeros(1 << BITS), -4.0, np.zeros((2, 2)))
    gw, gb, gt = np.full(1 << BITS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(steps):
        p, expected = marginals(m.weight[f].sum(0) + m.bias, head, size, m.trans)
        off = g - p
        d = sum(np.bincount(row, off, 1 << BITS) for row in f) - 0.2 * m.weight
        db, dt = off.sum(), pairs - expected - 0.05 * m.trans
        gw, gb, gt = gw + d * d, gb + db * db, gt + dt * dt
        m.weight += 0.5 * d / np.sqrt(gw)
        m.bias += 0.5 * db / np.sqrt(gb)
        m.trans += 0.2 * dt / np.sqrt(gt)
    return m


def tag(texts: pa.Array, model: Crf | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and offending spans of each text."""
    score, spans = np.zeros(len(texts)), [[] for _ in range(len(texts))]
    for b in blocks(texts, limit=TAG_BYTES) if model else ():
        if not len(b.code):
            continue
        head, size = chains(b)
        p, _ = marginals(model.weight[features(b)].sum(0) + model.bias, head, size, model.trans)
        full = np.diff(b.first) > 0
        score[b.lo : b.hi][full] = np.maximum.reduceat(p, b.first[:-1][full])
        bad = p >= threshold
        if not bad.any():
            continue
        own = b.owner
        joined = np.zeros(len(bad), bool)
        joined[1:] = bad[1:] & bad[:-1] & (own[1:] == own[:-1])
        begin = np.flatnonzero(bad & ~joined)
        stop = np.flatnonzero(bad & ~np.append(joined[1:], False))
        chars = char_of_byte(b.raw)
        zero = chars[b.offsets[own[begin]]]
        for d, x, y in zip(own[begin].tolist(), (chars[b.start[begin]] - zero).tolist(), (chars[b.end[stop]] - zero).tolist()):
            spans[b.lo + d].append({"start": x, "end": y})
    return score, spans


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Crf | None:
    """Fits a model on at most ``sample`` labelled documents of each class, taken by hash of the id."""
    pick = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    pick = pick.groupBy("_id").agg(F.max("_y").alias("_y"))
    key = F.xxhash64("_id")
    pick = pick.where("_y = 0").orderBy(key, "_id").limit(sample).unionByName(pick.where("_y = 1").orderBy(key, "_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(pick), "_id")  # bounded by sample
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    got = rows.toArrow().sort_by([("_id", "ascending"), ("_text", "ascending")])
    return fit(got["_text"].to_pylist(), got["_y"].to_pylist())


def score_documents(docs: DataFrame, model: Crf | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, ``score`` and ``spans`` of every row of ``docs``; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            score, spans = tag(batch.column(1), shared.value, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, spans_type)], names=[id_col, "score", "spans"])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, {SCHEMA}")


def toxic_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score reaches ``threshold``, with score and offending spans."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, sample=sample)
    return score_documents(docs, model, id_col=id_col, text_col=text_col, threshold=threshold).where(F.col("score") >= threshold)


def keep_clean(docs: DataFrame, model: Crf | None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is below ``threshold``; decided while scanning, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = tag(batch.column(text_col), shared.value, threshold)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
