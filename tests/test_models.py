"""Steps that ask a model, with callables in its place."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from grainsieve.operators import clarity, domain, evaluation, governance, models, tables
from grainsieve.plans import engine
from grainsieve.sources import clients, files

CTX = domain.Context("support", 1.0, "Acme", ["billing"], {"SLA": "Service Level Agreement"}, ["Pro"])
TAIL = " These ten words stay here because nothing is wrong with them."


def chunks(spark, *texts):
    return spark.createDataFrame([(i, "Billing", t) for i, t in enumerate(texts, 1)], "chunk long, heading string, content string")


def test_governance_by_a_model(spark):
    def judge(prompt):
        if "boom" in prompt:
            raise RuntimeError
        if "no json" in prompt:
            return "sorry"
        return 'Sure: [{"finding": 1, "valid": false}, {"finding": 2, "valid": true, "detector": "pii_financial"}, {"finding": "new", "detector": "pii_name", "evidence": "Tom", "reason": "a name"}, {"finding": "new", "detector": "odd", "evidence": "x"}]'

    texts = ("Mail a.b@x.com. Delete it. Tom.", "boom a.b@x.com", "no json a.b@x.com", "nothing", None)
    found = governance.with_findings(chunks(spark, *texts))
    got = {r.chunk: r.findings for r in models.validated(found, judge).collect()}
    assert [(f.detector, f.tag) for f in got[1]] == [("pii_financial", "pii"), ("pii_name", "pii")] and got[1][1].evidence == "Tom"
    assert [[f.detector for f in got[k] or []] for k in (2, 3, 4, 5)] == [["pii_email"], ["pii_email"], [], []]

    def edit(prompt):
        passage = prompt.split("Passage:\n")[1]
        return {"A": "", "B": passage, "C": passage + " and" * 99}.get(passage[0], passage.replace("a.b@x.com", "us"))

    df = governance.with_findings(chunks(spark, "A a.b@x.com" + TAIL, "B a.b@x.com" + TAIL, "C a.b@x.com" + TAIL, "D a.b@x.com" + TAIL, "Delete." + TAIL))
    out = {r.chunk: r for r in models.remediated(df, edit).collect()}
    assert [out[k].remediated for k in range(1, 6)] == [False, False, False, True, False]
    assert out[4].content == "D us" + TAIL and out[4].findings == [] and len(out[5].findings) == 1 and out[1].content == "A a.b@x.com" + TAIL


def test_clarity_by_a_model(spark):
    df = clarity.with_findings(chunks(spark, "They meet. The platform works.", "As mentioned above, the rule holds.", None), CTX)
    out = models.resolved_terms(df, CTX, lambda p: '[{"term": "they", "resolves_to": "the sales team", "confidence": "high"}, {"term": "the platform", "resolves_to": "a thing", "confidence": "low"}]')
    got = {f.term: (f.proposal, f.confident) for r in out.where("chunk = 1").collect() for f in r.clarity}
    assert got["They"] == ("the sales team", True) and got["The platform"] == ("a thing", False)
    new = {r.chunk: r.clarity for r in models.rewritten_sentences(df, lambda p: "The rule holds. [HIGH]" if p.endswith("the rule holds.") else "").collect()}
    assert [(f.proposal, f.confident) for f in new[2] if f.issue == "reference"] == [("The rule holds.", True)] and new[3] == df.where("chunk = 3").first().clarity
    assert "The rule holds." in clarity.fix(models.rewritten_sentences(df, lambda p: "The rule holds. [HIGH]"), CTX).where("chunk = 2").first().content


def test_contradictions_headings_and_descriptions(spark):
    found = spark.createDataFrame([(k, k + 1, "numeric", "a", "b", f"case {k}", 0.3, "low", "a", "newer") for k in range(4)], "a long, b long, conflict string, evidence_a string, evidence_b string, rationale string, score double, confidence string, winner string, reason string")
    answers = {"case 0": '{"valid": false}', "case 1": '{"valid": true, "winner": "b", "reason": "more exact", "confidence": "high"}', "case 2": '{"winner": "both"}', "case 3": "?"}
    got = {r.a: r for r in models.judged_conflicts(found, lambda p: next(v for k, v in answers.items() if k in p)).collect()}
    assert set(got) == {1, 2, 3} and (got[1].winner, got[1].score, got[1].confidence) == ("b", 0.8, "high") and got[2].winner == "" and (got[3].winner, got[3].score) == ("a", 0.3)
    named = spark.createDataFrame([("original", "Old", "x"), ("replaced", "Rule", "good"), ("replaced", "Rule", "bad")], "heading_source string, new_heading string, content string")
    said = models.headings(named, lambda p: '"Refund of payments"' if p.endswith("good") else "One")
    assert sorted(tuple(r) for r in said.select("new_heading", "heading_source").collect()) == [("Old", "original"), ("Refund of payments", "generated_model"), ("Rule", "replaced")]
    page = spark.createDataFrame([(1, "<h2>Plans</h2><table><tr><th>Plan</th></tr><tr><td>Pro</td></tr></table>[Figure 3: Sales chart]")], "doc_id long, html string")
    assert models.described(tables.tables(page), "table", lambda p: "Plans that are sold.").first().summary == "Plans that are sold"
    images = spark.createDataFrame([("3", "fig3_b.png", b"b"), ("3", "fig3_a.png", b"a"), ("4", "fig4_a.png", b"a")], "figure_no string, path string, content binary")
    assert [(r.figure_no, r.image_path) for r in tables.with_images(tables.figures(page), images).collect()] == [("3", "fig3_a.png")]


def test_verdicts_and_context(spark):
    pairs = spark.createDataFrame([("q", "alpha beta", "alpha", "answer"), ("q", "alpha", "alpha", "answer"), ("q", "x", None, "answer"), ("q", "x", None, "block")], "question string, expected_answer string, retrieved string, behavior string")
    judged = evaluation.judged(pairs, partial=0.5)
    assert [r.verdict for r in models.verdicts(judged, lambda p: '{"verdict": "correct"}', unclear_only=True).collect()] == ["correct", "correct", "incorrect", "correct"]
    assert [r.verdict for r in models.verdicts(judged, lambda p: '{"verdict": "odd"}').collect()] == [r.verdict for r in judged.collect()]
    said = json.dumps({"domain_type": "hr", "company_name": "Umbra", "actors": ["Legal", 3], "acronyms": {"PTO": "Paid Time Off"}, "products": ["Max"]})
    both, only, failed = models.inferred(CTX, ["x"], lambda p: said), models.inferred(CTX, ["x"], lambda p: said, only=True), models.inferred(CTX, ["x"], lambda p: "no")
    assert (both.domain_type, both.company_name, both.actors, both.products) == ("hr", "Umbra", ["billing", "legal"], ["Pro", "Max"])
    assert only.actors == ["legal"] and only.acronyms == {"PTO": "Paid Time Off"} and failed == CTX


PAGE = """<h1>Acme Billing</h1><p>Acme refunds take 5 business days after review by the billing team. Write to anna.berg@acme.com for help. Customers may cancel plan renewals. {0}</p>
<h2>Notes</h2><p>The billing team handles invoice disputes for all customers. TODO: add details here about fees. They will call you about the SLA today. {0}</p>
<table><tr><th>Plan</th><th>Price</th></tr><tr><td>Pro</td><td>$9</td></tr></table>"""


@pytest.fixture(scope="module")
def docs():
    fill = "Customers can read about invoices, payments and the refund policy of the company on this page. " * 3
    return [{"id": "a", "title": "Acme - Billing", "text": PAGE.format(fill)}, {"id": "b", "text": PAGE.replace("5 business", "9 business").format(fill)}]


def test_run_with_a_model(spark, docs):
    def model(prompt):
        if prompt.startswith("Give a heading"):
            return "Disputes about invoices"
        if prompt.startswith("Say in one sentence"):
            return "Prices of the plans."
        if prompt.startswith("Edit this passage"):
            return prompt.split("Passage:\n")[1].replace("anna.berg@acme.com", "our staff").replace("TODO: add details here about fees.", "")
        return ""

    r = engine.analyze(spark, docs, engine.Config(model=model, embedder=lambda ts: [[float(len(t)), 1.0] for t in ts], judge="similarity_then_model", domain_mode="hybrid"))
    rows = r.chunks.collect()
    text = " ".join(c.content for c in rows)
    assert "our staff" in text and "anna.berg" not in text and "TODO" not in text and "Prices of the plans" in text and "Disputes about invoices" in {c.heading.split(" - ")[0] for c in rows}
    stats = {s.module_id: (s.detected, s.resolved) for s in r.stats.collect()}
    assert stats["A12"] == (2, 2) and stats["A31"][0] >= stats["A31"][1] > 0
    out = engine.evaluate(r, engine.Config(embedder=lambda ts: [[float(len(t)), 1.0] for t in ts]))
    assert "embedding" not in out["pairs"].columns and out["pairs"].count() > 0
    assert {x.source for x in out["by_source"].collect()} >= {"topic", "governance"}
    measured = {(m.module_id, m.name): m.value for m in r.measures.collect()}
    assert measured["A32", "total_chunks"] > 0 and measured["A32", "pairs_evaluated"] > 0 and measured["A13", "words_out"] > measured["A13", "words_in"] > 0 and ("A22", "total_dates") in measured
    tokens = {(t.change_type, t.reason): t.tokens for t in evaluation.token_accounting(r.changes).collect()}
    assert tokens["added", "table"] > 0 and tokens["added", "heading"] > 0 and tokens[None, None] == sum(t.token_count for t in r.changes.collect())
    left = {x.module_id: x.pending for x in engine.issues(r, {"A31": 10_000}).collect()}
    assert left["A31"] == 0 and left["A12"] == 0


def test_destructive_phrases_of_the_corpus_tag_chunks(spark):
    text = "Customers may cancel their plan here. To cancel plan renewals write early. Nothing else on this page needs a word of caution."
    r = engine.analyze(spark, [text])
    assert r.findings["A31_domain"].count() > 0 and {c.tag for c in r.chunks.collect()} == {"destructive"}
    assert {f.detector for f in r.findings["A31"].collect()} == {"destructive_domain"}
    off = engine.analyze(spark, [text], engine.Config(detectors_off=("destructive",)))
    assert {c.tag for c in off.chunks.collect()} == {"content"}


def test_clients():
    class Server(BaseHTTPRequestHandler):
        seen = []

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Server.seen.append((self.path, self.headers.get("Authorization")))
            if len(Server.seen) == 1:
                self.send_response(503)
                self.end_headers()
                return
            answer = {"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}]} if "messages" in body else {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    try:
        assert clients.chat(url, "m", key_variable="HOME")("abc") == "ABC" and clients.embedder(url, "m")(["a", "b"]) == [[1.0], [2.0]]
        assert [p for p, _ in Server.seen] == ["/v1/chat/completions"] * 2 + ["/v1/embeddings"] and Server.seen[0][1].startswith("Bearer ")
    finally:
        server.shutdown()


def test_answers_leave_other_columns_alone(spark):
    df = spark.createDataFrame([(1, "ab", [("x", 1)], None), (2, None, None, b"z")], "id long, p string, nested array<struct<a:string,b:int>>, raw binary")
    out = files.call_model(df, "p", "a", str.upper)
    assert [tuple(r) for r in out.drop("a").collect()] == [tuple(r) for r in df.collect()] and [r.a for r in out.collect()] == ["AB", None]
    assert files.embed(df, "p", "v", lambda ts: [[1] for _ in ts]).select("v").collect()[1].v is None
    assert out.where(F.col("a").isNull()).count() == 1
