"""Information-theoretic sanitisation of personal data (operator 9).

Protected entities are e-mail and IP addresses, phone, card and social security numbers,
account numbers and credentials. They are replaced by the name of their kind. A term of
the words around an entity may give it away even so: over all documents, with n(e) those that
hold entity e, n(t) those with term t, n(t, e) those with t near e, of N, the share of the
information about e that t discloses is PMI(t, e) / I(e) = log(n(t,e) N / (n(t) n(e))) / log(N / n(e)),
1 where t is only ever seen near e. Terms seen near e in at least ``support`` documents whose
share reaches ``disclosure`` are generalised in the documents that hold e (to a word for
what they are), from ``removal`` on they are removed. Documents without an entity stay as they
are, byte for byte.

Documents are searched for entities once; those that hold some are written, with their entities and the terms near
them, and all else is made of that table. One more scan counts the terms, one passes on the other documents.

Null texts stay null, empty ones empty. Terms are compared in lower case. Rows are counted and treated one by
one: repeated rows count as often as they occur. Texts are read whole. An empty table gives an empty one.
All columns are kept, whatever their names and nulls; ``counts`` replaces columns of its names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.store import written
from grainsieve.llm.words import blocks, signed

WINDOW = 8
SUPPORT = 3
DISCLOSURE = 0.9
REMOVAL = 0.99
SIEVE_BITS = 22
SLICE_ROWS = 512

#: Kind and pattern. Each match is an entity, named by its text without blanks and in lower case.
KINDS = (
    ("EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("CREDENTIAL", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9_\-]{16,}|\bxox[abprs]-[A-Za-z0-9\-]{10,}|\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*|(?i:\b(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)\b)\s*[=:]\s*(?:\"[^\"\s]{4,}\"|'[^'\s]{4,}'|[^\s\"']{4,})|\b[0-9a-f]{32,}\b"),
    ("IP", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("CARD", r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?![\w]|\.\d)"),
    ("SSN", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    ("PHONE", r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?:[ .\-]\d{2,4})?(?![\w\-]|\.\d)|(?<![\w.])\+\d{8,15}(?!\w)"),
)
_ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS), re.ASCII)
#: What a text needs to hold for any entity: passes over most texts quickly.
_HINT = r"@|[0-9][ .\-]?[0-9]|AKIA|ASIA|gh[pousr]_|sk-|xox|eyJ|[0-9a-f]{32}|(?i:(?:password|passwd|pwd|secret|token|key)\s*[=:])"
_TERM = re.compile(r"[^\W_]+")


def find(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the entities of a text."""
    return [(m.start(), m.end(), m.lastgroup) for m in _ENTITY.finditer(text)]


def name_of(kind: str, surface: str) -> str:
    return f"{kind}:{re.sub(r'\s+', '', surface).lower()}"


def hash_texts(texts: list[str]) -> list[int]:
    """64-bit codes of words and entity names, equal for equal lower-case words."""
    out: list[int] = []
    for b in blocks(pa.array(texts, pa.string())):
        full = b.hash_of(b.offsets[:-1], b.offsets[1:])
        out += signed(full).tolist()
    return out


def near(text: str, found: list[tuple[int, int, str]], window: int) -> list[tuple[str, set[str]]]:
    """Each entity's name and the terms within ``window`` words of it, without those of entities."""
    terms, k = [], 0
    for m in _TERM.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        if k == len(found) or m.end() <= found[k][0]:
            terms.append((m.start(), m.group().lower()))
    starts = np.array([s for s, _ in terms])
    out = []
    for s, e, kind in found:
        at = int(np.searchsorted(starts, s)) if len(starts) else 0
        out.append((name_of(kind, text[s:e]), {t for _, t in terms[max(0, at - window) : at + window]}))
    return out


def generalised(term: str) -> str:
    return "[NUMBER]" if term.isdigit() else "[CODE]" if any(c.isdigit() for c in term) else "[NAME]" if term[:1].isupper() else "[TERM]"


def cleaned(text: str, found: list[tuple[int, int, str]], soft: set[str], hard: set[str]) -> str:
    """The text with entities replaced, ``soft`` terms generalised and ``hard`` terms removed."""

    def terms(part: str) -> str:
        if not soft and not hard:
            return part
        return _TERM.sub(lambda m: "" if m.group().lower() in hard else generalised(m.group()) if m.group().lower() in soft else m.group(), part)

    out, last = [], 0
    for s, e, kind in found:
        out += [terms(text[last:s]), f"[{kind}]"]
        last = e
    return "".join([*out, terms(text[last:])])


def _hinted(column: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(column, _HINT).fill_null(False).to_numpy(zero_copy_only=False)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(lo, SLICE_ROWS)


_MENTIONS = "array<struct<e:long,t:long,term:string>>"


def holders(packed: DataFrame, window: int) -> DataFrame:
    """(row, text, es, mentions), written: the rows that hold entities, the entities' codes and the terms near each, once a document; t is null for the entity itself."""
    row_type = packed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(1)
            rows, names, es, ts, ends = [], [], [], [], [0]
            for i in np.flatnonzero(_hinted(texts)).tolist():
                text = texts[i].as_py()
                if not (found := find(text)):
                    continue
                by_name: dict[str, set[str]] = {}
                for name, terms in near(text, found, window):
                    by_name.setdefault(name, set()).update(terms)
                for name, terms in by_name.items():
                    es += [name] * (len(terms) + 1)
                    ts += ["", *sorted(terms)]
                rows.append(i)
                names.append(sorted(by_name))
                ends.append(len(es))
            part = batch.take(pa.array(rows, pa.int64()))
            t = pa.array([None if not w else h for h, w in zip(hash_texts(ts), ts)], pa.int64())
            struct = pa.StructArray.from_arrays([pa.array(hash_texts(es), pa.int64()), t, pa.array(ts, pa.string())], ["e", "t", "term"])
            codes = pa.array(hash_texts([n for ns in names for n in ns]), pa.int64())
            own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, names)]), pa.int32()), codes)
            yield pa.RecordBatch.from_arrays([*part.columns, own, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], names=["row", "text", "es", "mentions"])

    return written(packed.mapInArrow(run, f"row {row_type}, text string, es array<long>, mentions {_MENTIONS}"), "holders")


def _spaced(column: pa.Array) -> pa.Array:
    """Texts with blanks for the characters beyond ASCII that no term holds."""
    return pc.replace_substring_regex(column, r"[^\p{L}\p{N}\x00-\x7f]+", " ")


def term_documents(docs: DataFrame, text_col: str, sieve: np.ndarray) -> DataFrame:
    """(t, n): documents with term t, for the terms whose bit of the sieve is set (and others of equal bits)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(sieve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        held = np.zeros(0, np.uint64)
        for batch in batches:
            for b in blocks(_spaced(batch.column(0))):
                at = np.flatnonzero(bits[(b.code >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
                own, code = b.owner[at], b.code[at]
                order = np.lexsort((code, own))
                own, code = own[order], code[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
                held = np.concatenate([held, code[new]])
                if len(held) > 2_000_000:
                    yield _counts(held)
                    held = held[:0]
        yield _counts(held)

    return docs.select(text_col).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def _counts(codes: np.ndarray) -> pa.RecordBatch:
    t, n = np.unique(codes, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(signed(t)), pa.array(n.astype(np.int64))], names=["t", "n"])


def disclosing_terms(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE, held: DataFrame | None = None) -> DataFrame:
    """(e, term, share) of the terms that disclose entity e, a code, by at least ``disclosure``; ``held`` are its ``holders`` if known."""
    if held is None:
        held = holders(docs.select(F.struct(F.lit(0).alias("x")).alias("row"), F.col(f"`{text_col}`").alias("text")), window)
    mentions = held.select(F.inline("mentions"))
    pairs = mentions.groupBy("e", "t").agg(F.count("*").alias("n_te"), F.min("term").alias("term"))
    pairs = written(pairs.where((F.col("n_te") >= support)), "pairs")
    # at most 2**SIEVE_BITS numbers, whatever the data
    slots = pairs.where("t is not null").select(F.shiftrightunsigned("t", 64 - SIEVE_BITS).cast("int").alias("s")).distinct().toArrow()["s"].to_numpy()
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[slots] = True
    counts = term_documents(docs, text_col, sieve)
    total = docs.select(F.count("*").alias("n_all"))
    whole = pairs.where("t is null").select("e", F.col("n_te").alias("n_e"))
    near_by = pairs.where("t is not null").join(whole, "e").join(counts, "t").crossJoin(F.broadcast(total))  # one row
    share = F.log(F.col("n_te") * F.col("n_all") / (F.col("n") * F.col("n_e"))) / F.log(F.col("n_all") / F.col("n_e"))
    return near_by.where("n_all > n_e").select("e", "term", share.alias("share")).where(F.col("share") >= disclosure)


def sanitise(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE, removal: float = REMOVAL, counts: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with sanitised texts.

    With ``counts``, two more columns: ``pii_entities`` and ``pii_terms``, the numbers of replaced
    entities and of distinct terms generalised or removed; they replace columns of these names.
    """
    columns = [c for c in docs.columns if not counts or c not in ("pii_entities", "pii_terms")]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    packed = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    row_type = packed.schema["row"].dataType.simpleString()
    held = holders(packed, window)
    told = disclosing_terms(docs, text_col=text_col, window=window, support=support, disclosure=disclosure, held=held)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(1)
            keep = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(_hinted(texts)).tolist():
                keep[i] = _ENTITY.search(texts[i].as_py()) is None
            yield batch.filter(pa.array(keep)).select(["row"])

    clean = packed.mapInArrow(without, f"row {row_type}").select("row", F.lit(0).alias("pii_entities"), F.lit(0).alias("pii_terms"))
    keyed = held.withColumn("key", F.xxhash64("text"))
    # equal texts have equal entities and terms
    terms = keyed.select("key", F.explode("es").alias("e")).distinct().join(told, "e").groupBy("key").agg(F.collect_set(F.struct("term", "share")).alias("terms"))

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts, n_e, n_t = [], [], []
            for text, listed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                share: dict[str, float] = {}
                for x in listed or []:
                    share[x["term"]] = max(x["share"], share.get(x["term"], 0.0))
                hard = {t for t, s in share.items() if s >= removal}
                found = find(text)
                texts.append(cleaned(text, found, share.keys() - hard, hard))
                n_e.append(len(found))
                n_t.append(len(share))
            old = batch.column(0)
            fields = [pa.array(texts, pa.string()) if k == at else old.field(k) for k in range(old.type.num_fields)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(old.type)), pa.array(n_e, pa.int32()), pa.array(n_t, pa.int32())], names=["row", "pii_entities", "pii_terms"])

    dirty = keyed.join(terms, "key", "left").select("row", "text", "terms").mapInArrow(redact, f"row {row_type}, pii_entities int, pii_terms int")
    out = clean.unionByName(dirty)
    fields: list[Column] = [F.col("row")[c].alias(c) for c in columns]
    return out.select(*fields, *(["pii_entities", "pii_terms"] if counts else []))
