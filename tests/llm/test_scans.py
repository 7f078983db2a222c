"""Operators that scan: HTML extraction (3), SentencePiece (5), toxicity (6), language (7), decontamination (8), PII (9)."""

import itertools
import os
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import words
from pyspark.sql import functions as F

from grainsieve.llm import decontaminate, html, langid, pieces, pii, toxicity

PAGES = "page_id long, url string, html string, host string, text string, id string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", None, "x") for i, u, h in rows], PAGES)


class Words(HTMLParser):
    """The words of a page by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.quiet, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.quiet += tag in ("script", "style", "template", "title")
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.quiet -= tag in ("script", "style", "template", "title")
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.quiet:
            self.parts.append(data)


def parsed(page):
    w = Words()
    w.feed(page or "")
    w.close()
    return "".join(w.parts).split()


def brute_main(rows, length=6):
    streams = [(i, (u or "").split("/")[2].lower() if u else "", parsed(h)) for i, u, h in rows]
    seen = {}
    for k, (i, host, w) in enumerate(streams):
        for p in range(len(w) - length + 1):
            seen.setdefault((host, *w[p : p + length]), set()).add(i if i is not None else ("row", k))
    out = []
    for i, host, w in streams:
        gone = set()
        for p in range(len(w) - length + 1):
            if len(seen[(host, *w[p : p + length])]) > 1:
                gone |= set(range(p, p + length))
        lines, line = [], []
        for p, x in enumerate(w):
            if p in gone:
                lines, line = (lines + [" ".join(line)] if line else lines), []
            else:
                line.append(x)
        out.append((i, "\n".join(lines + [" ".join(line)] if line else lines), len(w) - len(gone), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("host_bytes", [1 << 20, 10])
def test_html_matches_brute_force(spark, host_bytes):
    menu = "<nav><ul>" + "".join(f"<li>menu item {k}</li>" for k in range(5)) + "</ul></nav>"
    rows = [(i, f"https://{'a' if i % 3 else 'B'}.example.com/{i}", f"<html><head><title>t</title><style>p {{}}</style><script>var x='</p>';</script></head>{menu}<p>{words(i, 8 * i)}</p><!-- gone --><footer>All rights &amp; wrongs reserved by us {i}</footer>") for i in range(1, 25)]
    rows += [(30, None, None), (31, None, ""), (32, "https://a.example.com/x", rows[3][2]), (32, "https://a.example.com/x", rows[3][2]), (33, "https://c.example.com/", "<p>" + words(1, 20_000)), (None, "https://d.example.com/", "one two three four five six seven"), (None, "https://d.example.com/", "one two three four five six seven")]
    got = sorted(((r.page_id, r.text, r.kept_words, r.removed_words) for r in html.main_text(pages(spark, rows), host_bytes=host_bytes).collect()), key=str)
    assert got == brute_main(rows)
    # ids of any type
    named = pages(spark, rows).withColumn("page_id", F.expr("'page ' || page_id"))
    again = [(int(r.page_id[5:]) if r.page_id else None, r.text, r.kept_words, r.removed_words) for r in html.main_text(named, host_bytes=host_bytes).collect()]
    assert sorted(again, key=str) == got
    assert html.main_text(pages(spark, [])).collect() == []


def test_shared_keys_over_batches():
    rng = np.random.default_rng(0)
    rows = sorted(zip(rng.integers(0, 9, 90).tolist(), rng.integers(0, 4, 90).tolist()))
    pages_of = {}
    for k, p in rows:
        pages_of.setdefault(k, set()).add(p)
    want = sorted((k, p) for k, ps in pages_of.items() if len(ps) > 1 for p in ps)
    for size in (1, 2, 7, 100):
        cut = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[a : a + size]]), pa.array([p for _, p in rows[a : a + size]])], names=["key", "page"]) for a in range(0, len(rows), size)]
        assert [(k, p) for b in html.shared_keys(cut) for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())] == want


@pytest.mark.parametrize("host_bytes", [1 << 20, 10])
def test_html_rows_of_null_id_are_pages_of_their_own(spark, host_bytes):
    same = "one two three four five six seven"
    rows = [(None, "https://d.example.com/", same), (None, "https://d.example.com/", same), (None, "https://d.example.com/", "alone " + words(1, 9)), (7, "https://e.example.com/", same), (7, "https://e.example.com/", same)]
    got = sorted(((r.page_id, r.text, r.kept_words, r.removed_words) for r in html.main_text(pages(spark, rows), host_bytes=host_bytes).collect()), key=str)
    assert got == brute_main(rows) and got.count((None, "", 0, 7)) == 2 and got.count((7, same, 7, 0)) == 2


MODEL = pieces.PATH
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")


@needs_model
def test_pieces_match_the_library(spark, odd):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    extra = [(20 + k, t) for k, t in enumerate(["  two  spaces ", "tab\tand\nline", "ab" * 3000, "naïve café — “quoted” 12,345.67", "日本語のテキスト", "▁ low", "a", " ", "   ", "don't stop!!!", "� ​"])]
    rows = [(r.doc_id, r.text) for r in odd().collect()] + extra
    got = pieces.encode_documents(odd(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    for i, t in rows:
        if t is not None and i is not None:
            assert by[i].token_ids == lib.encode(t) and by[i].n_tokens == len(by[i].token_ids)
            assert by[i].exact == (lib.decode(lib.encode(t)) == t) or "▁" in t
    assert by[1].token_ids == [] and by[1].n_tokens == 0
    assert pieces.encode_documents(odd([])).collect() == []


@needs_model
def test_pieces_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = pieces.encode_documents(docs)
    assert tokens.where("not exact").count() == 0
    both = pieces.decode_documents(tokens).withColumnRenamed("text", "again").join(docs, "doc_id")
    assert both.where("again <> text").count() == 0 and both.count() == docs.count()


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    s, t = rng.normal(size=5), rng.normal(size=(2, 2))
    p, pair = toxicity.marginals(s, np.array([0]), np.array([5]), t)
    weight = {y: np.exp(sum(s[k] * y[k] for k in range(5)) + sum(t[y[k - 1], y[k]] for k in range(1, 5))) for y in itertools.product((0, 1), repeat=5)}
    z = sum(weight.values())
    assert np.allclose(p, [sum(w for y, w in weight.items() if y[k]) / z for k in range(5)])
    assert np.allclose(pair, [[sum(w * sum(y[k - 1] == a and y[k] == b for k in range(1, 5)) for y, w in weight.items()) / z for b in (0, 1)] for a in (0, 1)])


def test_spans_match_enumeration():
    """Scores and spans of texts against the sum over all labellings of each sentence."""
    import re

    rng = np.random.default_rng(3)
    model = toxicity.Crf(rng.normal(size=1 << toxicity.BITS) * 1.5, -0.5, rng.normal(size=(2, 2)))
    texts = ["Héllo wörld, one two. Three four five six seven! eight\nnine ten 日本 x", None, "", "...", "a b c d e f g h", "Ünder_score don't"]
    score, spans = toxicity.tag(pa.array(texts, pa.string()), model, 0.6)
    for text, got, own in zip(texts, score, spans):
        found, best = [], 0.0
        low = (text or "").lower()
        words_of = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9\x80-\U0010ffff]+", low)]
        chains = []
        for k, (a, b) in enumerate(words_of):
            if k and not re.search(r"[.!?\n]", low[words_of[k - 1][1] : a]):
                chains[-1].append((a, b))
            else:
                chains.append([(a, b)])
        for chain in chains:
            s = []
            for a, b in chain:
                (block,) = toxicity.blocks(pa.array([low[a:b]]))
                s.append(sum(model.weight[int(f)] for f in toxicity.features(block)[:, 0]) + model.bias)
            weight = {y: np.exp(sum(v * x for v, x in zip(s, y)) + sum(model.trans[i, j] for i, j in zip(y[:-1], y[1:]))) for y in itertools.product((0, 1), repeat=len(s))}
            p = [sum(w for y, w in weight.items() if y[k]) / sum(weight.values()) for k in range(len(s))]
            best = max([best, *p])
            found += [(a, b, x >= 0.6, k == 0) for k, ((a, b), x) in enumerate(zip(chain, p))]
        want = []
        for k, (a, b, bad, _) in enumerate(found):
            if bad and k and found[k - 1][2]:
                want[-1][1] = b
            elif bad:
                want.append([a, b])
        assert abs(got - best) < 1e-9 and [[x["start"], x["end"]] for x in own] == want


def test_languages_match_brute_force():
    """Families, languages and margins by adding up the weights of each run of bytes."""
    rng = np.random.default_rng(5)
    texts = {"en": "the house and the garden are green %d", "de": "das Haus und der Garten sind grün %d", "fr": "la maison et le jardin sont verts %d", "es": "la casa y el jardín son verdes %d", "xx": "zz qq ww zz %d"}
    rows = [(t % k + " " + t, lang) for k in range(12) for lang, t in texts.items()]
    m = langid.fit([t for t, _ in rows], [lang for _, lang in rows])
    asked = [" ".join(rng.permutation(t.split())) for t, _ in rows[:25]] + [None, "", "12 34!", "ü", "la"]
    families, languages, margins = langid.predict(pa.array(asked, pa.string()), m)

    def slot(c, n):
        x = c[0] * 257 + c[1]
        x = x if n == 2 else x * 263 + c[2]
        x = x * 2654435761 % 2**32
        return (x if n == 2 else (x + 77) % 2**32 * 2654435761 % 2**32) >> (32 - langid.BITS)

    for text, family, language, margin in zip(asked, families, languages, margins):
        c = [b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode()]
        if all(b == 32 for b in c):
            assert (family, language, margin) == ("und", "und", 0.0)
            continue
        score = {}
        for k, side in enumerate(m.sides):
            runs = [slot(c[i : i + n], n) for n in (2, 3) for i in range(len(c) - n + 1)]
            score[side] = float(sum(m.weight[r, k] for r in runs)) * 20 / max(1, 2 * len(c) - 3) + m.bias[k]

        def choose(names):
            if len(names) == 1:
                return names[0], np.inf
            side = lambda a, b: score[a, b] if (a, b) in score else -score[b, a]  # noqa: E731, B023
            rank = [(sum(side(o, a) > 0 if (o, a) in score else side(o, a) >= 0 for o in names if o != a), sum(side(o, a) for o in names if o != a)) for a in names]  # noqa: B023
            a = names[max(range(len(names)), key=rank.__getitem__)]
            return a, min(side(o, a) for o in names if o != a)

        f, sure = choose(sorted(m.members))
        lang, inner = choose(m.members[f])
        assert (family, language) == (f, lang) and abs(margin - min(sure, inner)) < 1e-3


def labelled(spark, odd, n=300):
    bad = ["vilething", "hatefoo", "curseword"]
    rng = np.random.default_rng(4)
    rows = [(i, words(i, 40) + ". " + (" ".join(rng.choice(bad, 3)) + " you. " if i % 3 == 0 else "you there. ") + words(i + 999, 30)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i, _ in rows if i < n // 2] + [(None, 1, "x"), (99_999, 0, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    return rows, odd(rows), labels


def test_toxic_documents_held_out(spark, odd):
    rows, docs, labels = labelled(spark, odd)
    got = {r.doc_id: r for r in toxicity.toxic_documents(docs, labels).collect()}
    assert set(got) == {i for i, _ in rows if i % 3 == 0}
    for i, t in rows[150:]:
        if i in got:
            assert any("vilething" in t[s.start : s.end] or "hatefoo" in t[s.start : s.end] or "curseword" in t[s.start : s.end] for s in got[i].spans)
    model = toxicity.train(docs, labels)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _ in rows if i % 3]
    assert toxicity.keep_clean(odd(), model).count() == odd().count()


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxic_documents(odd(), none).collect() == []
    assert toxicity.toxic_documents(odd([]), none).collect() == []
    assert {r.score for r in toxicity.score_documents(odd(), None).collect()} == {0.0}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = docs.where("doc_id % 2 = 0")
    got = langid.identify(docs.where("doc_id % 2 = 1"), langid.train(half)).join(docs, "doc_id")
    right, n = got.agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert right >= 0.95 * n
    assert {r.family for r in got.select("family").distinct().collect()} <= {"germanic", "romance", "und"}


def test_language_of_odd_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(odd(), langid.train(docs)).collect()}
    assert len(langid.identify(odd(), langid.train(docs)).collect()) == odd().count()
    assert all((got[i].language, got[i].margin) == ("und", 0.0) for i in (1, 2, 8))
    assert langid.train(odd([])) is None
    assert {r.language for r in langid.identify(odd(), None).collect()} == {"und"}


def test_language_of_many_copies_is_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200").select("text", "lang")
    rare = sorted({r.lang for r in docs.select("lang").distinct().collect()})[0]
    few = docs.where(F.col("lang") == rare).dropDuplicates(["text"]).orderBy("text").limit(5)
    copies = few.crossJoin(spark.range(400)).drop("id")
    model = langid.train(docs.where(F.col("lang") != rare).unionByName(copies), sample=10)
    assert rare in {x for langs in model.members.values() for x in langs}


def brute_containment(docs, items, n=decontaminate.N, share=decontaminate.CONTAINMENT):
    import re

    split = lambda t: [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (t or "").lower()) if w]
    out = set()
    for d, t in docs:
        w = split(t)
        for i, it in items:
            v = split(it)
            want = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)}
            best = max((len(want & {tuple(w[q : q + n]) for q in range(p, min(p + len(v) - n, len(w) - n) + 1)}) for p in range(len(w) - n + 1)), default=0) if want else 0
            if want and best >= share * len(want) - 1e-9:
                out.add((d, i, round(best / len(want), 6)))
    return out


def test_containment_matches_brute_force(spark, odd):
    items = [(k, words(50 + k, 8 + 3 * k)) for k in range(6)] + [(7, None), (8, ""), (9, "two words"), (10, words(50, 8))]
    rng = np.random.default_rng(2)
    rows = []
    for d in range(40):
        w = words(200 + d, 60).split()
        it = items[d % 6][1].split()
        it = [x if rng.random() > 0.06 * (d % 5) else "zz" for x in it]
        rows.append((d, " ".join(w[:20] + (it if d % 4 else it[: len(it) // 2]) + w[20:])))
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id int, text string, doc_id string, containment int")
    for portion in (10, 1_000_000):
        got = {(r.doc_id, r.item_id, round(r.containment, 6)) for r in decontaminate.contaminated(odd(rows), bench, portion=portion).collect()}
        assert got == brute_containment(rows, items)
    dirty = {d for d, _, _ in got}
    kept = decontaminate.keep_clean(odd(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _ in rows if d not in dirty] and kept.columns == odd(rows).columns
    assert decontaminate.contaminated(odd(), bench).collect() == [] and decontaminate.contaminated(odd([]), bench).collect() == []
    assert decontaminate.contaminated(odd(rows), bench.where("false")).collect() == []
    assert decontaminate.keep_clean(odd(), bench).count() == odd().count()


def test_entities_are_replaced(spark, odd):
    rows = [(1, "mail ann.b@example.com now"), (2, "call +1 555-201-4477 or (020) 7946 0958"), (3, "ip 10.0.0.12, ssn 123-45-6789"), (4, "card 4111 1111 1111 1111"), (5, "password: hunter22 end"), (6, "nothing here 12 and 3.14"), (7, None), (8, ""), (8, "")]
    got = {r.doc_id: r for r in pii.sanitise(odd(rows)).collect()}
    assert got[1].text == "mail [EMAIL] now" and "555" not in got[2].text and "7946" not in got[2].text
    assert got[3].text == "ip [IP], ssn [SSN]" and got[4].text == "card [CARD]" and "hunter22" not in got[5].text
    assert got[6].text == rows[5][1] and got[7].text is None and got[8].text == ""
    assert got[1].pii_entities == 1 and got[6].pii_entities == 0
    assert pii.sanitise(odd(rows)).count() == len(rows) and pii.sanitise(odd([])).count() == 0
    assert pii.sanitise(odd(), counts=False).columns == odd().columns


def brute_terms(rows, window=pii.WINDOW, support=pii.SUPPORT, least=pii.DISCLOSURE):
    """(entity, term): share, from counts over all rows; words are runs of letters and digits of any script."""
    import re
    from collections import Counter
    from math import log

    n_e, n_t, n_te = Counter(), Counter(), Counter()
    for _, t in rows:
        pairs, names = set(), set()
        spots = [(m.start(), m.end(), m.lastgroup) for m in pii._ENTITY.finditer(t)]
        around = [(m.start(), m.group().lower()) for m in re.finditer(r"[^\W_]+", t) if not any(s < m.end() and m.start() < e for s, e, _ in spots)]
        for s, e, kind in spots:
            name = f"{kind}:{''.join(t[s:e].split()).lower()}"
            names.add(name)
            pairs |= {(name, w) for w in [w for at, w in around if at < s][-window:] + [w for at, w in around if at > s][:window]}
        n_e.update(names)
        n_te.update(pairs)
        n_t.update({w.lower() for w in re.findall(r"[^\W_]+", t)})
    n = len(rows)
    share = {(e, t): log(c * n / (n_t[t] * n_e[e])) / log(n / n_e[e]) for (e, t), c in n_te.items() if c >= support and n > n_e[e]}
    return {k: x for k, x in share.items() if x >= least}


def test_disclosing_terms_match_brute_force(spark, odd):
    odd_words = ["\u201czorblax\u201d", "zorblax\u2019s", "\u2013zorblax\u2014", "zorblax\u00a0"]
    rows = [(i, f"{words(i, 6)} the {odd_words[i // 4 % 4]} founder wrote from z.founder@example.com about things {words(i + 50, 6)}" if i % 4 == 0 else f"{words(i, 20)} the things about founder and wrote") for i in range(60)]
    rows += [(100 + i, f"{words(i, 9)} card 4 1 1 1-1 1 1 1-1 1 1 1-1 1 1 1 of Xenia {words(i + 9, 9)}") for i in range(5)]
    want = brute_terms(rows)
    told = pii.disclosing_terms(odd(rows)).collect()
    codes = {name: pii.hash_texts([name])[0] for name, _ in want}
    assert {t for _, t in want} >= {"zorblax", "xenia"}
    assert {(r.e, r.term): round(r.share, 9) for r in told} == {(codes[e], t): round(x, 9) for (e, t), x in want.items()}
    got = {r.doc_id: r for r in pii.sanitise(odd(rows)).collect()}
    for i, t in rows:
        names = {pii.name_of(k, t[s:e]) for s, e, k in pii.find(t)}
        gone = {w for (e, w) in want if e in names}
        held = got[i].text.lower().split()
        assert not gone & set(held) and (got[i].text == t) == (not names)
        kept = [w for w in t.lower().split() if w.isalnum() and w not in gone and not any(c.isdigit() for c in w[:1])]
        assert [w for w in held if w in set(kept)] == kept and got[i].pii_terms == len(gone)


def test_masks():
    assert pa.array(pii.hash_texts(["a", "b", "a"]))[0] == pa.array(pii.hash_texts(["a"]))[0]
