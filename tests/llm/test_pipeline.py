"""Every stage of the pipeline on odd rows and on planted ones."""

import os

import pytest
from pyspark.sql import functions as F
from llm_texts import words

import corpus_pipeline
from grainsieve.llm import decontaminate, pieces


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    item = words(77_777, 30)
    bad = "vilething hatefoo curseword"
    rows = [(i, words(i, 60) + (f". {bad} {bad} you. " if i % 5 == 0 else ". ") + words(i + 500, 40)) for i in range(300)]
    rows += [(1200, rows[1][1]), (1201, rows[1][1] + " tail"), (1202, words(9, 30) + " " + item + " " + words(10, 30)), (1203, words(11, 30) + " write to a.b@example.com"), (1204, None), (1205, ""), (1206, "one"), (1207, "one"), (None, "lost id")]
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows


@pytest.mark.skipif(not os.path.exists(pieces.PATH), reason="no tokenizer files")
def test_stages_keep_what_is_clean(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(stage(spark, kept[-1], d))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept[-1].dtypes == docs.dtypes
    ids = [sorted((r.doc_id for r in k.collect()), key=str) for k in kept]
    start = [i for i, _ in rows]
    toxic = {i for i in range(300) if i % 5 == 0}
    assert ids[1] == sorted((i for i in start if i not in toxic), key=str)
    assert ids[2] == sorted((i for i in start if i not in toxic | {1200, 1201, 1207}), key=str)
    assert ids[3] == sorted((i for i in start if i not in toxic | {1200, 1201, 1202, 1207}), key=str)
    assert ids[4] == ids[3] == ids[5]
    clean = {r.doc_id: r for r in kept[4].collect()}
    assert "[EMAIL]" in clean[1203].text and clean[1203].n_chars == len(clean[1203].text) and clean[1204].text is None
    assert clean[7].text == dict(rows)[7]
    assert {r.exact for r in kept[5].where("doc_id <> 1204").collect()} == {True}
    assert [tuple(r)[:3] for r in corpus_pipeline.run(spark, d).orderBy("doc_id").collect()] == [tuple(r)[:3] for r in kept[5].orderBy("doc_id").collect()]


@pytest.mark.skipif(not os.path.exists(pieces.PATH), reason="no tokenizer files")
def test_stages_on_odd_rows(spark, tables, odd):
    """Nulls in any column, very long texts, repeated rows, further columns of clashing names, and ids of any type."""
    d, _ = tables
    docs = odd().withColumn("_id", F.lit("a")).withColumn("_text", F.lit("b")).withColumn("group_id", F.lit(1)).withColumn("pii_terms", F.lit("c"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.dtypes == docs.dtypes
        docs = out
    # 4 is 3's copy, 6 is 5's twice over, 10 is like 9; 1 and the null id have texts that stay
    assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted([1, 2, 3, 5, 7, 8, 9, None], key=str)
    named = odd([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None), (7, "same text here"), (7, "same text here"), (7, "another text there")]).withColumn("doc_id", F.expr("concat('n', doc_id)"))
    kept = corpus_pipeline.drop_near_duplicates(spark, named, d)
    assert sorted((r.doc_id, r.text) for r in kept.where("text is not null").collect()) == [("n1", "alpha beta gamma"), ("n7", "another text there"), ("n7", "same text here")]
    assert kept.where("text is null").count() == 1


def test_empty_documents(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0


def test_near_duplicates_match_brute_force_on_the_table(spark):
    """The second stage keeps exactly one row of each connected group."""
    from test_repeats import brute_groups

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = brute_groups(rows)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if want.get(i, i) == i}
    assert decontaminate.N == 3
