"""Language identification by hierarchical discrimination (operator 7).

Features are the shares of hashed runs of two and three bytes of the lower-cased text, digits
and punctuation taken as blanks. Linear support vector machines (squared hinge, one against
one) first choose the family of languages; others, one for each pair of languages of that
family, then vote for the language. Ties of votes go to the larger sum of margins, then to the
language first in the alphabet.

The machines are fitted on at most ``sample`` labelled documents of each language, taken by
hash of the text; everything is scored on whole texts. Texts without any letter (empty, null, digits
only) have family and language ``und`` and margin 0, as all have where fewer than one language is
labelled. Rows are scored one by one; repeated rows get equal results. A language that isn't
in the map of families is a family of its own. Ids may be of any type and null. Null languages aren't learnt
from. An empty table gives an empty result. Columns other than id and text (and language, to learn), whatever their names,
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.words import cut, text_buffers

BITS = 13
SAMPLE = 400
UNKNOWN = "und"
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk", "uz"), "turkic"),
    **dict.fromkeys(("hi", "bn", "mr", "ur", "fa", "pa", "gu"), "indo-iranian"),
}

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Hierarchy:
    """Weights of all machines side by side; ``families`` and ``pairs`` name the two sides of each."""

    weight: np.ndarray
    bias: np.ndarray
    sides: list[tuple[str, str]]
    members: dict[str, list[str]]


def slots(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots of the pairs and triples that begin at each byte, and which hold a letter."""
    c = _FOLD[raw]
    n = len(c)
    pair, triple = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    if n > 2:
        pair[:-1] = c[:-1] * 257 + c[1:]
        triple[:-2] = pair[:-2] * 263 + c[2:]
    mult = np.uint32(2654435761)
    solid = c != 32
    return ((pair * mult) >> np.uint32(32 - BITS)).astype(np.int32), ((triple * mult + np.uint32(77)) * mult >> np.uint32(32 - BITS)).astype(np.int32), solid


def blocks_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = text_buffers(pc.utf8_lower(column.fill_null("")))
    for lo, hi in cut(offsets, 1 << 20):
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of shares for each text, and which texts have letters."""
    size = 1 << BITS
    x, ok = np.zeros((len(column), size), np.float32), np.zeros(len(column), bool)
    for lo, _, raw, offsets in blocks_of(column):
        pair, triple, solid = slots(raw)
        for d, (s, e) in enumerate(zip(offsets[:-1], offsets[1:])):
            ok[lo + d] = solid[s:e].any()
            counts = np.bincount(pair[s : max(s, e - 1)], minlength=size) + np.bincount(triple[s : max(s, e - 2)], minlength=size)
            x[lo + d] = counts * (20.0 / max(1, 2 * (e - s) - 3))
    return x, ok


def svm(x: np.ndarray, y: np.ndarray, c: float = 30.0, steps: int = 80) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient descent; y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1), np.float32)])
    side = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w = np.zeros(z.shape[1], np.float32)
    v = np.random.default_rng(1).normal(size=z.shape[1]).astype(np.float32)
    for _ in range(15):
        v = z.T @ (z @ v)
        top = np.linalg.norm(v)
        v /= top
    rate = 1.0 / (1.0 + 2 * c * side.max() * top / len(y))
    at, old = w.copy(), w.copy()
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (z @ at))
        grad = at - z.T @ ((2 * c / len(y)) * side * slack * y).astype(np.float32)
        w = at - rate * grad
        at = w + (k / (k + 3)) * (w - old)
        old = w
    return w[:-1], float(w[-1])


def fit(texts: list[str | None], languages: list[str], families: dict[str, str] = FAMILIES) -> Hierarchy | None:
    if not texts:
        return None
    x, ok = vectors(pa.array(texts, pa.string()))
    lang = np.array(languages)
    x, lang = x[ok], lang[ok]
    if not len(lang):
        return None
    fam = np.array([families.get(v, v) for v in lang])
    sides, weight, bias = [], [], []
    members = {f: sorted(set(lang[fam == f].tolist())) for f in sorted(set(fam.tolist()))}
    for names, of in [(sorted(members), fam), *((m, lang) for m in members.values())]:
        for a, b in combinations(names, 2):
            both = (of == a) | (of == b)
            w, c = svm(x[both], np.where(of[both] == b, 1.0, -1.0))
            sides.append((a, b))
            weight.append(w)
            bias.append(c)
    return Hierarchy(np.stack(weight, 1) if weight else np.zeros((1 << BITS, 0), np.float32), np.array(bias), sides, members)


def vote(m: Hierarchy, score: np.ndarray, names: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner among ``names`` for the rows ``at``, and its smallest margin."""
    if len(names) == 1:
        return np.zeros(len(at), int), np.full(len(at), np.inf)
    votes, margin = np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
    least = np.full((len(at), len(names)), np.inf)
    for i, j in combinations(range(len(names)), 2):
        s = score[at, m.sides.index((names[i], names[j]))]
        votes[:, j] += s > 0
        votes[:, i] += s <= 0
        margin[:, j] += s
        margin[:, i] -= s
        least[:, j] = np.minimum(least[:, j], s)
        least[:, i] = np.minimum(least[:, i], -s)
    best = (votes + 1e-9 * np.clip(margin, -1e6, 1e6)).argmax(1)
    return best, least[np.arange(len(at)), best]


def predict(column: pa.Array, m: Hierarchy | None) -> tuple[list[str], list[str], np.ndarray]:
    n = len(column)
    family, lang, sure = np.full(n, UNKNOWN, object), np.full(n, UNKNOWN, object), np.zeros(n)
    if m is None:
        return family.tolist(), lang.tolist(), sure
    score, ok = np.zeros((n, len(m.sides))), np.zeros(n, bool)
    for lo, hi, raw, offsets in blocks_of(column):
        pair, triple, solid = slots(raw)
        size = np.diff(offsets)
        letters = np.append(0, np.cumsum(solid))
        ok[lo:hi] = np.diff(letters[offsets]) > 0
        for k in range(len(m.sides)):
            w = m.weight[:, k]
            for which, cutoff in ((pair, 1), (triple, 2)):
                run = np.append(0.0, np.cumsum(w[which], dtype=np.float64))
                score[lo:hi, k] += run[np.maximum(offsets[1:] - cutoff, offsets[:-1])] - run[offsets[:-1]]
            score[lo:hi, k] = score[lo:hi, k] * (20.0 / np.maximum(1, 2 * size - 3)) + m.bias[k]
    rows = np.flatnonzero(ok)
    names = sorted(m.members)
    best, margin = vote(m, score, names, rows)
    sure[rows] = margin
    for f, name in enumerate(names):
        at = rows[best == f]
        family[at] = name
        inner, margin = vote(m, score, m.members[name], at)
        lang[at] = np.array(m.members[name], object)[inner]
        sure[at] = np.minimum(sure[at], margin)
    sure[~np.isfinite(sure)] = 0.0
    return family.tolist(), lang.tolist(), sure


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> Hierarchy | None:
    """Fits the machines on at most ``sample`` documents of each language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}  # a row for each language; copies count once, as below
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 62) * min(1.0, 3.0 * sample / n)))])
    got = rows.where(F.shiftrightunsigned(F.xxhash64("text"), 2) <= F.try_element_at(share, "lang")).dropDuplicates(["lang", "text"]).toPandas()
    got["key"] = [hash_text(t) for t in got["text"]]
    got = got.sort_values(["lang", "key", "text"]).groupby("lang").head(sample)
    return fit(got["text"].tolist(), got["lang"].tolist(), families)


def hash_text(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def identify(docs: DataFrame, model: Hierarchy | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``family``, ``language`` and ``margin`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 32 KB a machine
    kept = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, lang, sure = predict(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(family, pa.string()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=[id_col, "family", "language", "margin"])

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, family string, language string, margin double")
