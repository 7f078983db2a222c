"""Whole runs: sources, engine, streaming."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from grainsieve.operators.domain import Context
from grainsieve.plans import engine
from grainsieve.sources import files
from grainsieve.streaming import documents as stream

PAGE = """<h1>Acme Billing</h1><p>Acme refunds take 5 business days after review by the billing team. Write to anna.berg@acme.com for help. {}</p>
<h2>Notes</h2><p>The billing team handles invoice disputes for all customers. TODO: add details here about fees. They will call you about the SLA today. {}</p>
<table><tr><th>Plan</th><th>Price</th></tr><tr><td>Pro</td><td>$9</td></tr></table>"""


def test_run_and_evaluation(spark):
    fill = "Customers can read about invoices, payments and the refund policy of the company on this page. " * 3
    docs = [{"id": "a", "title": "Acme - Billing", "text": PAGE.format(fill, fill), "metadata": {"last_modified": "2025-12-01", "author": "Ann"}}, {"id": "b", "text": PAGE.replace("5 business", "9 business").format(fill, fill)}, "Plain text about shipping parcels to other countries by sea and air every single week of the year.", 7]
    r = engine.analyze(spark, docs, engine.Config(custom_rules=[{"pattern": "shipping parcels", "action": "block", "reason": "no"}]))
    chunks = r.chunks.collect()
    text = " ".join(c.content for c in chunks)
    assert {c.doc_id for c in chunks} == {"a", "b", "doc_3"} and "anna.berg" not in text and "TODO" not in text and "$9" in text
    assert [c.behavior for c in chunks if c.doc_id == "doc_3"] == ["block"]
    assert {f.detector for f in r.findings["A31"].collect()} >= {"pii_email", "placeholder"}
    assert {f.conflict for f in r.findings["A32"].collect()} == {"numeric"}
    assert {s.module_id for s in r.stats.collect()} == {"A12", "A13", "A22", "A30", "A31", "A32"}
    out = engine.evaluate(r)
    assert out["metrics"].first().total == out["pairs"].count() > 0
    assert engine.totals(r.stats).where("module_id IS NULL").count() == 1


def test_contradictions_are_asked(spark):
    fill = "Customers can read about invoices, payments and the refund policy of the company on this page. " * 3
    docs = [{"id": "a", "text": PAGE.format(fill, fill)}, {"id": "b", "text": PAGE.replace("5 business", "9 business").format(fill, fill)}]
    r = engine.analyze(spark, docs)
    chunks = {c.chunk: c for c in r.chunks.collect()}
    found = r.findings["A32"].collect()
    assert found
    for f in found:
        assert (chunks[f.chunk_a].doc_no, chunks[f.chunk_b].doc_no) == (f.a >> 20, f.b >> 20)
        assert "5 business days" in chunks[f.chunk_a].content and "9 business days" in chunks[f.chunk_b].content
    out = engine.evaluate(r)
    asked = [p for p in out["pairs"].collect() if p.source == "consistency"]
    assert asked and all(p.behavior == "caveat" and p.must_review and p.chunk in chunks for p in asked)
    assert {x.source for x in out["by_source"].collect()} >= {"topic", "consistency"}
    assert out["coverage"].where("source = 'consistency' AND behavior IS NULL").first().questions == len(asked)


def test_equal_ids_are_different_documents(spark):
    text = "This page explains shipping of parcels to other countries by sea and air in {} weeks."
    r = engine.analyze(spark, [{"id": "x", "text": text.format("two")}, {"id": "x", "text": text.format("three")}], engine.Config(phases=(1,)))
    assert sorted(c.content for c in r.chunks.collect()) == sorted([text.format("two"), text.format("three")])
    assert {c.doc_no for c in r.chunks.collect()} == {0, 1}


def test_from_any(spark):
    assert [r.doc_id for r in files.from_any(spark, ["x", {"id": 5, "text": "y"}, 3]).collect()] == ["doc_1", "5"]
    assert files.from_any(spark, []).count() == 0
    with pytest.raises(ValueError):
        files.from_any(spark, 3)


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>hi</p>")
    (tmp_path / "b.docx").write_bytes(docx(("Heading2", "Head"), ("Normal", "Body")))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.xyz").write_text("no")
    got = {r.doc_id: r for r in files.load_directory(spark, str(tmp_path), metadata={"file_type": "own", "team": "x"}).collect()}
    assert set(got) == {"a.html", "b.docx"} and got["b.docx"].text == "<h2>Head</h2>\n<p>Body</p>" and got["a.html"].title == "a"
    assert got["a.html"].metadata["file_type"] == "own" and got["a.html"].metadata["team"] == "x"
    assert files.load_file(spark, str(tmp_path / "a.html")).first().text == "<p>hi</p>"
    with pytest.raises(FileNotFoundError):
        files.load_file(spark, str(tmp_path / "none.html"))
    with pytest.raises(ValueError):
        files.load_file(spark, str(tmp_path / "d.xyz"))


def test_sinks_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("1", 'with "quotes"\nand lines, commas')], "id string, question string")
    files.write_test_set(df, str(tmp_path / "set"))
    assert [tuple(r) for r in files.read_test_set(spark, str(tmp_path / "set")).collect()] == [tuple(r) for r in df.collect()]
    files.write_results({"t": df}, str(tmp_path / "res"))
    assert spark.read.json(str(tmp_path / "res/t")).count() == 1
    cache = files.PhaseCache(spark, str(tmp_path / "cache"))
    key = cache.key("some text")
    assert not cache.has(key, "1")
    assert cache.save(key, "1", df).count() == 1 and cache.has(key, "1") and cache.age_seconds(key, "1") < 600
    cache.clear(key, "1")
    assert not cache.has(key, "1")


def test_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "boom")], "id long, p string")

    def call(p):
        if p == "boom":
            raise RuntimeError
        return p.upper()

    assert {r.id: r.a for r in files.call_model(df, "p", "a", call).collect()} == {1: "AB", 2: None, 3: None}
    e = files.embed(df.where("p is not null"), "p", "v", lambda ts: [[len(t), 0] for t in ts], batch=1)
    assert {r.id: r.v for r in e.collect()} == {1: [2.0, 0.0], 3: [4.0, 0.0]}


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Write to a.b@x.com now. These other ten words stay right here in this text always.", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in"))
    s = stream.read_documents(spark, str(tmp_path / "in"))
    stream.write(stream.cleaned(s, Context(), "2026-01-01").select("doc_id", "content", "tag"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert "a.b@x.com" not in spark.read.parquet(str(tmp_path / "out")).first().content
    timed = stream.read_documents(spark, str(tmp_path / "in")).withColumn("t", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    q = stream.word_counts(timed, time_col="t").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.word for r in spark.table("wc").collect()} >= {"write", "words"}
