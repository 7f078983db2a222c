"""Operators on small literals with results worked out by hand."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.vocabulary import domain_defaults
from grainsieve.operators import chunking, clarity, consistency, domain, evaluation, governance, structure, tables, temporal
from grainsieve.plans import queries

CTX = domain.Context("support", 1.0, "Acme", ["billing"], {"SLA": "Service Level Agreement"}, ["Pro"])


def chunks(spark, *texts, heading="Billing"):
    return spark.createDataFrame([(i, heading, t) for i, t in enumerate(texts, 1)], "doc_id long, heading string, content string")


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(F.expr(expr).alias("x")).first().x


def test_text(spark):
    assert one(spark, T.word_count("t"), t=" a b\n c ") == 3
    assert one(spark, T.words("t", 4), t="Über über Haus_x word WORD words4") == ["word", "word"]
    assert one(spark, T.plain("t"), t="<p>One:</p><li>two.</li> <b>3</b>") == "One: two. 3"
    assert one(spark, T.sentences("t", True), t="A b. C d! e? F") == ["A b.", "C d! e?", "F"]
    got = one(spark, T.matches("t", "b+"), t="abba b")
    assert [(m.match, m.before, m.after) for m in got] == [("bb", "a", "a b"), ("b", "abba ", "")]
    assert one(spark, f"transform({T.matches('t', 'TODO')}, m -> {T.evidence('m')})", t="One. Two\nthree TODO x! Four.") == ["three TODO x!"]


def test_detectors(spark):
    df = chunks(spark, "Mail a.b@x.com or billing@x.com.", "TODO one TODO two. TBD here.", "Contact: Anna Berg now. Contact: Billing Team now.", "escalate to the team. contact support at 5", "refer to Figure 2, refer to annex", None, "")
    got = sorted((r.doc_id, r.detector, r.matched) for r in governance.findings(df).collect())
    assert got == [(1, "pii_email", "a.b@x.com"), (2, "placeholder", "TBD"), (2, "placeholder", "TODO"), (3, "pii_name", "Contact: Anna Berg"), (4, "escalation_no_details", "escalate to the team"), (5, "broken_reference", "refer to annex")]
    strict = governance.findings(df, governance.detectors("strict")).where("detector = 'pii_email'").count()
    lenient = governance.findings(df, governance.detectors("lenient")).where("detector = 'pii_email'").count()
    off = governance.findings(df, governance.detectors(off=("pii",))).where("tag = 'pii'").count()
    assert (strict, lenient, off) == (2, 0, 0)


def test_cleaning(spark):
    tail = " These ten words stay here because nothing is wrong with them."
    df = chunks(spark, "Write to a.b@x.com today." + tail, "INTERNAL NOTE: hush." + tail, "Delete it." + tail, "~~old~~ text." + tail, "TODO x.", None, tail.strip())
    got = {r.doc_id: r for r in governance.clean(governance.with_findings(df)).collect()}
    assert got[1].content == tail.strip() and got[1].changed and got[1].tag == "content"
    assert got[2].content == "" and got[2].words == 0
    assert got[3].content == "Delete it." + tail and got[3].tag == "destructive" and not got[3].changed
    assert "old" not in got[4].content and got[5].content == "" and got[6].content is None
    assert got[7].content == tail.strip() and not got[7].changed
    behaved = {r.tag: r.behavior for r in governance.behavior(spark.createDataFrame([("pii",), ("stale",), ("content",)], "tag string"), {"stale": "allow"}).collect()}
    assert behaved == {"pii": "block", "stale": "allow", "content": "answer"}


def test_inline_and_destructive_phrases(spark):
    df = chunks(spark, "Please Cancel  your plan. We cancel your plan. To delete plan data.")
    phrases = domain.destructive_phrases(df)
    assert {r.phrase for r in phrases.collect()} == {"cancel plan", "delete plan"}
    got = governance.destructive_in_domain(chunks(spark, "Now delete plan x. And delete plan y.", "undelete planet"), phrases).collect()
    assert [(r.doc_id, r.phrase, r.evidence) for r in got] == [(1, "delete plan", "Now delete plan x.")]


def test_raw_chunks(spark):
    assert chunking.fill(["a b", "c d", "e f g"], 4) == ["a b c d", "e f g"]
    text = "One two three four five six. Seven eight nine ten."
    assert chunking.split_long(text, 8) == ["One two three four five six.", "Seven eight nine ten."]
    assert chunking.split_long("a " * 10, 4) == ["a a a a", "a a a a", "a a"]
    assert chunking.merge_short(["a", "b c", "d e f"], 2, 3) == ["a b c", "d e f"]
    df = spark.createDataFrame([(1, "<p>one two three four</p><p>no</p>"), (2, ""), (3, None), (4, "tiny bit")], "doc_id long, text string")
    got = chunking.raw_chunks(df).collect()
    assert [(r.doc_id, r.chunk_no, r.content) for r in got] == [(1, 1, "one two three four.")]
    long = spark.createDataFrame([(1, "word " * 5000)], "doc_id long, text string")
    assert [r.words for r in chunking.raw_chunks(long).collect()] == [200] * 25


def test_smart_chunks(spark):
    a, b = "The billing invoice covers refund payments. " * 8, "Shipping parcels travel across oceans slowly. " * 8
    got = chunking.section_chunks("H", (a + b).strip(), 20, 60, 0.1)
    assert len(got) >= 2 and all(len(t.split()) <= 60 for _, t in got) and " ".join(t for _, t in got) == (a + b).strip()
    assert chunking.merge_chunks([("A - 1", "x y"), ("A - 2", "z")], 5, 10, 0.1) == [("A", "x y z")]
    assert chunking.merge_chunks([("A", "alpha"), ("B", "omega")], 5, 10, 0.1) == [("A", "alpha"), ("B", "omega")]
    s = chunking.split_sentences(a + b)
    df = spark.createDataFrame([(a + b,)], "content string").select(F.expr(chunking.boundaries(chunking.sentence_list("content"))).alias("b"))
    assert df.first().b == chunking.shifts(s, 0.1)


def test_sections_and_headings(spark):
    h = "<p>Lead text is here for all of the good people to read now.</p><h2 class='x'>Notes</h2><p>The billing group handles invoice disputes, refunds and other matters every day.</p><h3>Kept</h3>short<h2>Empty</h2>"
    df = spark.createDataFrame([(1, h), (2, None), (3, "")], "doc_id long, html string")
    got = structure.named_sections(df).orderBy("section_no").collect()
    assert [(r.section_no, r.level, r.heading) for r in got] == [(0, 0, ""), (1, 2, "Notes"), (2, 3, "Kept")]
    assert got[0].is_orphan and got[0].new_level == 2 and got[0].heading_source == "generated_rule"
    assert (got[1].new_heading, got[1].heading_source, got[1].original_heading) == ("Invoice disputes", "replaced", "Notes") and got[2].new_heading == "Kept"
    assert tuple(structure.summary(structure.named_sections(df)).first())[:2] == (2, 2)


def test_tables(spark):
    h = "<h2>Plans</h2><table><tr><th>Plan</th><th>Price</th></tr><tr><td>Pro</td><td>$9</td></tr><tr><td>Free</td><td>-</td></tr></table><table></table><ol><li>Go\non</li></ol>[Figure 3: Sales chart]"
    df = spark.createDataFrame([(1, h), (2, None)], "doc_id long, html string")
    t = tables.tables(df).collect()
    assert len(t) == 1 and t[0].type == "comparison" and t[0].row_texts == ["Plans — Pro: Price: $9.", "Plans — Free: ."]
    assert tables.procedures(df).first().content == "Step 1: Go on."
    f = tables.figures(df).first()
    assert (f.type, f.is_gap, f.summary) == ("chart", True, "Figure 3: Sales chart (no description)")
    new = {r.doc_id: r.html for r in tables.normalized(df).collect()}
    assert "Plans — Pro: Price: $9." in new[1] and "Step 1: Go on." in new[1] and "<td>" not in new[1] and new[2] is None


def test_dates(spark):
    df = spark.createDataFrame([("Updated March 3, 2024. Sept. 1999. Q3 2025, 2025-13-01, 2025/07/01 v1.2 Version 3", "2025-06-30T01:00"), (None, "x"), ("", None)], "content string, last_modified string")
    got = temporal.enrich(df, "2026-01-01").collect()
    assert [(d.type, d.year, d.month, d.age_months) for d in got[0].dates] == [("month_year", 2024, 3, 22), ("quarter", 2025, 7, 6), ("iso", 2025, 7, 6)]
    assert got[0].newest_date.raw == "Q3 2025" and got[0].versions == ["1.2", "3"] and got[0].page_age_months == 7 and got[0].is_stale
    assert got[1].page_age_months is None and not got[1].is_stale and got[2].newest_date is None


def test_domain(spark):
    df = chunks(spark, "Acme rocks. Acme team. Acme here. Acme Corp (AC) wins. The billing team handles refunds. Billing reviews invoices. ABC ABC ABC SLA XY-1", "patient ticket ticket refund billing")
    assert {r.acronym: r.expansion for r in domain.acronyms(df).collect()} == {"ABC": None, "SLA": "Service Level Agreement", "AC": "Acme Corp"}
    assert {r.actor for r in domain.actors(df).collect()} >= {"billing"}
    c = domain.infer(df)
    assert (c.domain_type, c.company_name) == ("support", "Acme") and "billing" in c.actors
    assert domain.company_of_title("Acme - Guide") == "Acme" and domain.company_of_title("the guide") == ""
    assert domain.anchors({"refund": 5, "refunds": 2, "refundable": 3, "bill": 9, "billing": 2, "once": 1}) == {"refund": ["refund", "refundable", "refunds"], "bill": ["bill"], "billing": ["billing"]}
    assert domain.overridden(c, company_name="X", actors=["legal"]).company_name == "X"
    assert domain_defaults("hr")["acronyms"]["PTO"] == "Paid Time Off"
    empty = domain.infer(df.where("false"))
    assert (empty.domain_type, empty.detected) == ("general", 0)


def test_clarity(spark):
    df = chunks(spark, "They meet the SLA. The platform works. Contact them.\n1. a\n3. b", "As mentioned above, the rule holds.", None)
    got = {(r.doc_id, r.issue, r.term) for r in clarity.findings(df, CTX).collect()}
    assert got >= {(1, "pronoun", "They"), (1, "pronoun", "them"), (1, "acronym", "SLA"), (1, "vague_entity", "The platform"), (1, "sequence", "1 to 3"), (2, "reference", "As mentioned above, the rule holds.")}
    fixed = {r.doc_id: r.content for r in clarity.fix(clarity.with_findings(df, CTX), CTX).collect()}
    assert fixed[1].startswith("The billing team meet the SLA (Service Level Agreement). Acme works. Contact the billing team.") and fixed[3] is None


def test_consistency(spark):
    rows = [(1, "Refund time", "Standard refund review takes 5 days."), (2, "Refund time", "Standard refund review takes 7 days. More text."), (3, "Other", "Billing handles invoice disputes promptly. Legal handles invoice disputes promptly."), (20, "Far", "")]
    df = spark.createDataFrame(rows, "chunk long, heading string, content string").withColumn("page_age_months", F.expr("CAST(chunk AS int)")).withColumn("author", F.lit("Ann"))
    p = consistency.prepared(df, ["billing", "legal"], {"region": ["Europe"]})
    pairs = consistency.candidate_pairs(p)
    assert {(r.a, r.b) for r in pairs.collect()} >= {(1, 2), (2, 3)}
    found = consistency.scored(consistency.conflicts(p, pairs), p, priority_authors=["Bob"])
    got = {(r.a, r.b): r for r in found.collect()}
    assert got[1, 2].conflict == "numeric" and got[1, 2].winner == "a" and abs(got[1, 2].score - 0.5) < 1e-9 and got[3, 3].conflict == "authority"
    new = {r.chunk: r.content for r in consistency.resolve(p, found, threshold=0.4).collect()}
    assert new[2] == "More text." and new[1] == rows[0][2]
    decided = {r.chunk: r for r in consistency.decide(p, found, bulk_accept=True).collect()}
    assert decided[2].tag == "stale" and decided[1].tag == "content" and decided[3].conflicts


def test_evaluation(spark):
    pool = spark.createDataFrame([(1, "refund takes five days"), (2, "shipping takes weeks"), (3, "")], "chunk long, content string")
    asked = spark.createDataFrame([(1, "how many days for a refund"), (2, "zzz"), (3, None)], "question_id long, question string")
    best = evaluation.bm25(asked, pool).collect()
    assert [(r.question_id, r.chunk, r.rank) for r in best] == [(1, 1, 1)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "chunk long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "question_id long, embedding array<float>")
    assert [(r.chunk, r.score) for r in evaluation.cosine(q, v, k=2).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    pairs = spark.createDataFrame([("alpha beta", "alpha beta x", "answer"), ("alpha beta", None, "block"), ("", "x", "answer"), ("alpha beta gamma", "alpha beta", "answer")], "expected_answer string, retrieved string, behavior string")
    assert [r.verdict for r in evaluation.judged(pairs).collect()] == ["correct", "correct", "correct", "partial"]
    assert [r.verdict for r in evaluation.judged(pairs, compat=True).collect()][1] == "incorrect"
    assert evaluation.budgets({"topic": 9, "governance": 2, "clarity": 1, "consistency": 1}, total=8) == {"topic": 4, "governance": 2, "clarity": 1, "consistency": 1}
    m = evaluation.metrics(spark.createDataFrame([("caveat", "incorrect", "correct"), ("answer", "correct", "correct")], "behavior string, verdict_before string, verdict_after string")).first()
    assert (m.recall_before, m.recall_after, m.hallucination_before, m.risk_before, m.risk_after) == (0.5, 1.0, 1.0, 100.0, 0.0)


def test_cosine_asks_all_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(220, 8)).astype(np.float32)
    vectors[57] = vectors[50]
    spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    score = np.round(unit @ unit.T, 6)
    want = [(q, int(c), k + 1) for q in range(0, 220, 50) for k, c in enumerate(np.lexsort((np.arange(220), -score[q]))[:3])]
    assert sorted((r.question_id, r.chunk, r.rank) for r in queries.QUERIES["eval_cosine"](spark, str(tmp_path)).collect()) == sorted(want)


def test_inventories_are_whole(spark):
    letters = "bcdfghjklmnpqrstvwxz"
    rare = [a + b + c + d + "qz" for a in letters for b in letters for c in letters for d in letters][:10_100]
    c = domain.infer(chunks(spark, " ".join(rare), " ".join(rare)).withColumn("chunk_no", F.lit(0)))
    assert set(rare) <= set(c.anchors)


def test_arrays_are_computed_once(spark):
    """No detector is in a plan twice, as it would be where the optimizer filters on an array before it's made into rows."""
    df = chunks(spark, "x")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(governance.counts(governance.findings(df))).count("VPN") == plan(governance.with_findings(df)).count("VPN")
    assert plan(clarity.findings(df, CTX)).count("Them") == plan(clarity.with_findings(df, CTX)).count("Them")
    assert plan(domain.word_frequencies(df)).count("{4,}") == 1


def test_matches_of_long_texts(spark):
    """What stands around matches reaches over sentence and surroundings, wherever the text between is short."""
    rng = np.random.default_rng(1)
    parts = ["TODO", "x. ", "word ", "\n", "a longer piece of text without an end of a sentence that goes on and on for more than a hundred characters in all "]
    text = "".join(rng.choice(parts, 400))
    got, want = (one(spark, f"transform({T.matches('t', 'TODO', whole=w)}, m -> struct({T.evidence('m')} AS e, right(m.before, 100) AS b, left(m.after, 100) AS a))", t=text) for w in (False, True))
    assert len(want) > 50 and got == want


def test_reports(spark, tmp_path):
    scores = spark.createDataFrame([("a", "baseline", 0.2), ("a", "processed", 0.5), ("a", "processed", 0.7), ("b", "baseline", 0.4)], "category string, pool string, score double")
    got = {r.category: (r.baseline, r.processed, r.delta) for r in evaluation.compared(scores).collect()}
    assert [round(x, 9) for x in got["a"]] == [0.2, 0.6, 0.4] and got["b"] == (0.4, None, None)
    stats = spark.createDataFrame([("A30", 9, 4, 2), ("A31", 3, 3, None), ("A32", 1, 0, 5)], "module_id string, detected long, resolved long, confirmed long")
    assert {r.module_id: (r.auto, r.user, r.pending) for r in evaluation.module_issues(stats).collect()} == {"A30": (4, 2, 3), "A31": (3, 0, 0), "A32": (0, 5, 0)}
    changes = spark.createDataFrame([("added", "table", 3), ("added", "table", 4), ("removed", "pii", 5)], "change_type string, reason string, token_count long")
    assert {(r.change_type, r.reason): (r.tokens, r.changes) for r in evaluation.token_accounting(changes).collect()} == {("added", "table"): (7, 2), ("removed", "pii"): (5, 1), ("added", None): (7, 2), ("removed", None): (5, 1), (None, None): (12, 3)}
    for name in ("figure1_x.png", "figure_2_y.jpg", "fig3_z.gif", "other4_q.png", "fig_5.txt"):
        (tmp_path / name).write_bytes(name.encode())
    from grainsieve.sources import files

    assert {(r.figure_no, bytes(r.content)) for r in files.figure_images(spark, str(tmp_path)).collect()} == {("1", b"figure1_x.png"), ("2", b"figure_2_y.jpg"), ("3", b"fig3_z.gif")}


def test_previews_and_remediation(spark):
    df = chunks(spark, "short", "x" * 900, None)
    assert {r.doc_id: r.part for r in domain.sampled(df, most=2000).collect()} == {1: "short", 2: "x" * 900, 3: None}
    small = {r.doc_id: r.part for r in domain.sampled(df, most=300).collect()}
    assert small[1] == "short" and 200 < len(small[2]) <= 500
    tail = " These ten words stay here because nothing is wrong with them."
    tagged = governance.with_findings(chunks(spark, "TODO fill in." + tail, "TODO x.", "Delete it." + tail)).withColumn("tag", F.expr("IF(doc_id = 3, 'destructive', 'placeholder')"))
    got = {r.doc_id: (r.remediated, r.content) for r in governance.remediate(tagged).collect()}
    assert got == {1: (True, tail.strip()), 2: (False, "TODO x."), 3: (False, "Delete it." + tail)}


def test_cosine_by_blocks_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK_ROWS", 7)
    odd = [(None, [1.0, 2.0]), (90, None), (91, [0.0, 0.0]), (92, [1.0, None]), (93, [1.0]), (94, []), (95, [float("nan"), 1.0])]
    v = spark.createDataFrame([(i, [float(i % 5 - 2), float(i % 3 - 1)]) for i in range(60)] + odd, "chunk long, embedding array<double>")
    got = evaluation.cosine(v.withColumnRenamed("chunk", "question_id"), v, k=20)
    # blocks meet, not pairs of rows
    assert "zip_with" not in got._jdf.queryExecution().toString()
    v.createOrReplaceTempView("odd_vectors")
    norm = "sqrt(aggregate({0}.embedding, 0D, (s, x) -> s + x * x))"
    dot = "aggregate(zip_with(q.embedding, c.embedding, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    want = spark.sql(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk) AS rank FROM (SELECT q.chunk AS question_id, c.chunk,
        round(IF({norm.format('q')} = 0 OR {norm.format('c')} = 0, 0D, {dot} / ({norm.format('q')} * {norm.format('c')})), 6) AS score FROM odd_vectors q CROSS JOIN odd_vectors c WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL)) WHERE rank <= 20""")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_content_words_are_counted_within_rows(spark):
    texts = [(1, "beta alpha beta Über word𝒜 gamma gamma delta delta delta epsi zeta"), (2, None), (3, ""), (4, "with with lone"), (5, "alpha beta"), (5, "beta gamma beta"), (None, "none none"), (None, "none")]
    df = spark.createDataFrame(texts, "chunk long, content string")
    got = consistency.content_words(df)
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # in the row, not by a shuffle of all words
    assert sorted(map(repr, ((r.chunk, r["rank"], r.word) for r in got.collect()))) == sorted(map(repr, [
        (1, 1, "delta"), (1, 2, "beta"), (1, 3, "gamma"), (1, 4, "alpha"), (1, 5, "epsi"), (4, 1, "lone"), (5, 1, "beta"), (5, 2, "alpha"), (5, 3, "gamma"), (None, 1, "none")]))
    assert one(spark, T.squeeze("t"), t=" a  b  c \t d\n") == "a b c d" and one(spark, T.word_count("t"), t="  x\n\ny ") == 2
    assert one(spark, T.words("t", 4), t="𝒜word word𝒜 word😀word wordé x-word\nword") == ["word", "word", "word", "word"]


def test_pairs_make_topic_keys_once(spark):
    df = spark.createDataFrame([(10 * i, "", f"alpha topic{'abc'[i % 3] * 3} {'lone' + chr(97 + i)}") for i in range(24)] + [(None, "", "topicaaa")], "chunk long, heading string, content string")
    got = consistency.candidate_pairs(df)
    assert got._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    # alpha is in 24 chunks, which is too many
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((10 * i, 10 * j) for i in range(24) for j in range(i + 1, 24) if (j - i) % 3 == 0)


def test_pairs_read_texts_in_one_pass(spark):
    ids = [-1030, -1027, -1024, -1, 0, 3, 4, 10, 1022, 1023, 1026, 1031, 1032, 1032, 2047, 2048, 5000, None]
    df = spark.createDataFrame([(i, "", "") if i == 3 else (i, "", "a bit") for i in ids], "chunk long, heading string, content string")
    got = consistency.candidate_pairs(df)
    # topics and neighbours come from the pass that counts words; only ids are read besides, and texts of keys that repeat
    assert got._jdf.queryExecution().analyzed().toString().count("LogicalRDD") + got._jdf.queryExecution().analyzed().toString().count("LocalRelation") <= 4
    on = sorted({i for i in ids if i not in (3, None)})  # blank texts take no part
    assert sorted((r.a, r.b) for r in got.collect()) == [(a, b) for a, b in zip(on, on[1:]) if b - a <= 5]
    small = df.selectExpr("CAST(chunk AS int) AS chunk", "heading", "content")
    assert consistency.candidate_pairs(small).dtypes == [("a", "int"), ("b", "int")] and consistency.candidate_pairs(small).count() == got.count()


def test_words_counted_in_python_are_those_of_the_expression(spark):
    texts = ["Über über Haus_x word WORD words4", "\u0130STANbul \u212aelvin kelvin", "𝒜word word𝒜 word😀word wordé", "a\u00a0word\u2014word\u2003next…last", "co\u0301mbined e\u0301tude", "straße ΣΑΣ word\u00b2 ½word word\u0e01", "tab\tnew\nline\x1cform\x00null\x7fdele", "日本語word word日本語 ٣word", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.selectExpr("t", f"{T.words('t', 4)} AS w").collect():
        assert consistency.top_words(r.t.encode(), 99, frozenset()) == sorted(dict.fromkeys(r.w), key=lambda x: -r.w.count(x))
    # bytes that aren't UTF-8 cut, as they do there
    odd = spark.sql("SELECT CAST(X'776F7264FF6E657874C3' AS string) AS t")
    assert odd.selectExpr(f"{T.words('t', 4)} AS w").first().w == consistency.top_words(b"word\xffnext\xc3", 9, frozenset()) == ["word", "next"]


def test_bm25_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK_CHUNKS", 3)
    monkeypatch.setattr(evaluation, "BLOCK_QUESTIONS", 2)
    words = "alpha beta gamma delta epsi zeta".split()
    pool = [(i, " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 7))) for i in range(40)] + [(41, None), (42, ""), (7, "alpha alpha beta"), (None, "gamma"), (None, "delta")]
    asked = [(1, "alpha beta"), (2, "gamma gamma zeta"), (3, "nothing"), (4, None), (5, "delta alpha epsi"), (None, "beta")]
    got = evaluation.bm25(spark.createDataFrame(asked, "question_id long, question string"), spark.createDataFrame(pool, "chunk long, content string"), k=7)
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # blocks meet; neither words nor scores are shuffled
    rows = [(c, t.split()) for c, t in pool if t is not None]
    mean = sum(len(w) for _, w in rows) / len(rows)
    want = []
    for q, text in asked:
        scores = {}
        for term in set((text or "").split()):
            held = {}
            for c, w in rows:
                if term in w:
                    held[c, len(w)] = held.get((c, len(w)), 0) + w.count(term)
            for (c, n), f in held.items():
                scores[c] = scores.get(c, 0) + f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / mean))
        best = sorted(scores, key=lambda c: (-round(scores[c], 6), c is not None, c or 0))[:7]
        want += [(q, c, round(scores[c], 6), k) for k, c in enumerate(best, 1)]
    assert sorted(map(repr, ((r.question_id, r.chunk, r.score, r["rank"]) for r in got.collect()))) == sorted(map(repr, want))


def test_chunks_are_made_of_few_documents_at_a_time(spark):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "x": [None] * 1000})
    parts = list(chunking._slices(iter([batch, batch.slice(0, 3)])))
    assert max(p.num_rows for p in parts) <= 64 and sum(p.num_rows for p in parts) == 1003
    df = spark.createDataFrame([(i, " ".join(f"w{i}" for _ in range(3 * (i % 150)))) for i in range(300)] + [(None, "a b c d"), (301, None)], "doc_id long, text string").coalesce(1)
    got = sorted(map(repr, ((r.doc_id, r.chunk_no, r.words) for r in chunking.raw_chunks(df).collect())))
    want = [(i, k + 1, min(200, n - 200 * k)) for i in range(300) if (n := 3 * (i % 150)) for k in range(-(-n // 200)) if min(200, n - 200 * k) >= 3] + [(None, 1, 4)]
    assert got == sorted(map(repr, want))


def test_raw_chunks_are_cut_from_bytes(spark):
    odd = ["<P>One:</p><li>two.</LI> <b\n>3</b>", "a\u00a0b\u3000c\u2003d\u0085e \u1680f\u2028\u202f\u205fg\u200b h", "x. . .\n. y: . z :\t.", "x.\u00a0. \x1c . y", "a < b > c <d", "</D\u0130V></li>\u017f</\u017fp>", "\x1ca\x1fb\x85", "  ", "", "«é» …\U0001d49c  . ."]
    for t in odd:
        assert chunking.plain_bytes(t.encode()).decode() == one(spark, T.plain("t"), t=t), t
    rng = np.random.default_rng(3)
    pool = ["word", "Wort", "end.", "Éa", "straße!", "A", "ok?", "\U0001d49c.", "z" * 60, "B" * 70 + "."]
    for least, most in ((50, 200), (3, 8), (1, 1), (9, 4)):
        for _ in range(40):
            blocks = [" ".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(1, most * 3 if rng.random() < 0.4 else 12))) for _ in range(rng.integers(0, 9))]
            sized = [x for p in chunking.fill(blocks, most) for x in chunking.split_long(p, most)]
            want = [(x, len(x.split())) for x in chunking.merge_short(sized, least, most)]
            assert [(x.decode(), n) for x, n in chunking.raw_pieces([b.encode() for b in blocks], least, most)] == want
    texts = [(1, "<div>one two three four</DIV>five six<table x>seven eight nine ten\n \n a b c d"), (2, "few words"), (3, None), (4, " "), (5, "a b\u0003c d e f")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {1: ["one two three four.", "seven eight nine ten", "a b c d"], 2: ["few words"], 3: [], 4: [], 5: ["c d e f"]}
    assert {r.doc_id: r.blocks for r in chunking.with_blocks(df).collect()} == want
    # texts go to Python as they are: no pass over them for each pattern
    assert not any("regexp_replace" in x._jdf.queryExecution().toString() for x in (chunking.raw_chunks(df), chunking.with_blocks(df)))
    bad = spark.sql("SELECT 1L AS doc_id, CAST(X'6120FF622063' AS string) AS text")
    assert [r.content for r in chunking.raw_chunks(bad).collect()] == ["a \ufffdb c"]


def test_first_match_of_each_text(spark):
    text = "The SLA and the CRM, SLA; USA CRM " * 3
    got = one(spark, T.matches("t", r"\b[A-Z]{2,5}\b", first_of="d <> 'USA'"), t=text)
    every = one(spark, T.matches("t", r"\b[A-Z]{2,5}\b"), t=text)
    assert got == [every[0], every[1]] and [(m.ord, m.match) for m in got] == [(1, "SLA"), (2, "CRM")]


def test_beginnings_fit_detectors(spark):
    texts = ["INTERNAL NOTE", "for internal use only", "do not share", "confidential", "agents should", "not for public", "XXX", "TODO", "TBD", "HACK", "FIXME", "[insert x]", "to be defined", "placeholder", "coming soon", "add details here",
             "works automatically", "will be handled accordingly", "takes care of everything", "seamlessly handles", "handles all cases", "automatically handles", "most cases covered", "take appropriate action",
             "[image a - not available]", "refer to our x", "link broken", "image not available", "see the FAQ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, content string")
    assert {r.doc_id for r in governance.findings(df, [d for d in governance.detectors() if d.name in governance._FIRST]).collect()} == set(range(len(texts)))
