"""Substring dedup (2), suffix-array dedup (10), n-gram Jaccard join (4), against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import words

from grainsieve.llm import anchors, graph, jaccard, substrings, suffixes


def token_lists(rows):
    import re

    return {i: [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (t or "").lower()) if w] for i, t in rows}


def brute_spans(rows, length):
    docs = token_lists(rows)
    seen = {}
    for i, w in docs.items():
        for p in range(len(w) - length + 1):
            seen.setdefault(tuple(w[p : p + length]), set()).add(i)
    out = []
    for i, w in docs.items():
        hit = [p for p in range(len(w) - length + 1) if len(seen[tuple(w[p : p + length])]) > 1]
        for p in hit:
            if out and out[-1][0] == i and p <= out[-1][2]:
                out[-1][2] = p + length
            else:
                out.append([i, p, p + length])
    return sorted(map(tuple, out))


def planted(seed=0, n=60):
    rng = np.random.default_rng(seed)
    passages = [words(100 + k, int(rng.integers(45, 130))) for k in range(6)]
    rows = []
    for i in range(n):
        parts = [words(1000 + i, int(rng.integers(0, 120)))]
        for _ in range(rng.integers(0, 3)):
            parts += [passages[rng.integers(len(passages))], words(5000 + i, int(rng.integers(0, 30)))]
        rows.append((i, " ".join(parts)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 3, rows[3][1] + " more"), (n + 4, "a b " * 60), (n + 5, "a b " * 50), (n + 6, words(7, 50)), (n + 7, words(7, 50)), (n + 8, words(7, 49))]
    return rows


@pytest.mark.parametrize("find", [substrings.repeated_passages, suffixes.repeated_passages])
def test_passages_match_brute_force(spark, odd, find):
    rows = planted()
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in find(odd(rows)).collect())
    assert got == brute_spans(rows, 50)


@pytest.mark.parametrize("find", [substrings.repeated_passages, suffixes.repeated_passages])
def test_passages_of_odd_rows(spark, odd, find):
    got = {(r.doc_id, r.start_word, r.end_word) for r in find(odd()).collect()}
    assert got == {(3, 0, 30_000), (4, 0, 30_000), (9, 0, 80), (10, 0, 80)}
    assert find(odd([])).collect() == []
    # rows of one id aren't each other's repeats
    assert find(odd([(1, words(3, 60)), (1, words(3, 60))])).collect() == []


def template(n):
    """One passage in every document, each time between other words, and copies of it."""
    passage = words(900, 70)
    return [(i, f"{words(3000 + i, 8 + i % 60)} {passage} {words(7000 + i, i % 50)}") for i in range(n)] + [(n + 1, passage), (n + 2, passage)]


@pytest.mark.parametrize("find", [substrings.repeated_passages, suffixes.repeated_passages])
def test_a_passage_in_all_documents(spark, odd, find):
    rows = template(300)
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in find(odd(rows)).collect())
    assert got == brute_spans(rows, 50)
    # batches of few rows: what stands for many meets others in the sort
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted((r.doc_id, r.start_word, r.end_word) for r in find(odd(rows)).collect()) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("find", [substrings.repeated_passages, suffixes.repeated_passages])
def test_passages_of_ids_of_any_type(spark, odd, find):
    rows = planted(5)
    text_ids = odd(rows).selectExpr("concat('doc ', lpad(doc_id, 5, '0')) AS doc_id", "text", "doc_id AS id", "'x' AS value", "'y' AS key")
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in find(text_ids).collect())
    assert got == [(f"doc {i:05}", a, b) for i, a, b in brute_spans(rows, 50)]


@pytest.mark.parametrize("group_rows", [1, 5])
def test_crowded_prefixes_are_split(spark, odd, group_rows):
    rows = planted(3) + [(1000 + i, t) for i, t in template(40)]
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in substrings.repeated_passages(odd(rows), group_rows=group_rows).collect())
    assert got == brute_spans(rows, 50)


def test_streams_of_hot_keys():
    rng = np.random.default_rng(0)
    rows = sorted({(int(k), int(d), int(p)) for k, d, p in zip(rng.integers(0, 12, 200), rng.integers(0, 5, 200), range(200))} | {(20, 1, p) for p in range(40)} | {(21, d, 0) for d in range(50)})
    docs = {}
    for k, d, _ in rows:
        docs.setdefault(k, set()).add(d)
    size = {k: sum(r[0] == k for r in rows) for k in docs}
    want = [r for r in rows if len(docs[r[0]]) > 1]
    for n in (1, 3, 17, 500):
        cut = lambda: (pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + n]]) for c in range(3)], names=["key", "id", "pos"]) for a in range(0, len(rows), n))  # noqa: E731, B023
        assert [(r["key"], r["id"], r["pos"]) for b in anchors.shared_rows(cut(), "key", "id") for r in b.to_pylist()] == want
        told = [(r["id"], r["pos"], m, f) for b, many, first in anchors.decided(cut(), "key", "id") for r, m, f in zip(b.to_pylist(), many, first)]
        assert told == [(d, p, len(docs[k]) > 1, i == 0 or rows[i - 1][0] != k) for i, (k, d, p) in enumerate(rows)]
        for least in (1, 20, 45):
            heat = sorted((r["id"], r["pos"], r["hot"]) for b in substrings._with_heat(cut(), least) for r in b.to_pylist())
            assert heat == sorted((d, p, size[k] > least) for k, d, p in want)


def brute_groups(rows, n=jaccard.N, t=jaccard.THRESHOLD):
    sets = {i: ({tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()) for i, w in token_lists(rows).items() if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {i: g for g, members in groups.items() if len(members) > 1 for i in members}


def edited(text, share, seed):
    rng = np.random.default_rng(seed)
    return " ".join(w if rng.random() > share else "edit%d" % rng.integers(10**6) for w in text.split())


def test_groups_match_brute_force(spark, odd):
    rows = []
    for g in range(25):
        base = words(g, 20 + 12 * g)
        rows += [(100 * g + k, edited(base, 0.04 * k, 31 * g + k)) for k in range(1 + g % 5)]
    rows += [(9000, "tiny"), (9001, "tiny"), (9002, "two words"), (9003, ""), (9004, "")]
    want = brute_groups(rows)
    got = {r.doc_id: r.group_id for r in jaccard.near_duplicates(odd(rows)).collect()}
    missed = set(want) - set(got)
    assert len(missed) <= 0.1 * len(want) and set(got) <= set(want)
    assert all(got[i] == want[i] for i in got if not missed)


def test_groups_of_odd_rows(spark, odd):
    got = {r.doc_id: r.group_id for r in jaccard.near_duplicates(odd()).collect()}
    assert got == {3: 3, 4: 3, 5: 5, 6: 5, 9: 9, 10: 9}
    assert jaccard.near_duplicates(odd([])).collect() == []


def test_large_groups_stay_whole(spark, odd):
    base = words(1, 100)
    rows = [(i, edited(base, 0.01, i)) for i in range(600)]
    got = {r.doc_id: r.group_id for r in jaccard.near_duplicates(odd(rows)).collect()}
    assert len(got) == 600 and set(got.values()) == {0}


def test_pruning_keeps_pairs_at_the_threshold():
    # a pair whose agreements equal the threshold at each step is never dropped
    assert all(least <= jaccard.THRESHOLD * seen for seen, least in jaccard.limits(jaccard.THRESHOLD, jaccard.TOLERANCE))
    assert jaccard.reach(0, 63, 0.6) < 1e-9 < 1 - 1e-9 < jaccard.reach(63, 63, 0.6)


def near_threshold():
    """Families whose copies lie around the threshold, far more of a family's pairs just under or over it than well over."""
    rows = []
    for g, share in enumerate((0.05, 0.06, 0.07)):
        base = words(400 + g, 150)
        rows += [(1000 * g + k, edited(base, share, 7919 * g + k)) for k in range(150)]
    return rows


def test_pairs_near_the_threshold(spark, odd):
    rows = near_threshold()
    sets = {i: {tuple(w[p : p + jaccard.N]) for p in range(len(w) - jaccard.N + 1)} for i, w in token_lists(rows).items()}
    ids = sorted(sets)
    want = {(b, a) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= jaccard.THRESHOLD * len(sets[a] | sets[b]) - 1e-9}
    got = {(r.id, r.lead) for r in jaccard.similar_pairs(odd(rows)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_groups_near_the_threshold(spark, odd):
    rows = near_threshold()
    pairs = jaccard.similar_pairs(odd(rows)).collect()
    root = {}
    for r in sorted(pairs, key=lambda r: (r.lead, r.id)):
        root.setdefault(r.lead, r.lead), root.setdefault(r.id, r.id)
    while any(root[r.id] != root[r.lead] for r in pairs):
        for r in pairs:
            root[r.id] = root[r.lead] = min(root[r.id], root[r.lead])
    assert {r.doc_id: r.group_id for r in jaccard.near_duplicates(odd(rows)).collect()} == root


def test_crowded_buckets_are_split(spark, odd):
    rows = near_threshold() + [(9000 + i, edited(words(1, 100), 0.01, i)) for i in range(120)]
    whole = {r.doc_id: r.group_id for r in jaccard.near_duplicates(odd(rows)).collect()}
    assert {r.doc_id: r.group_id for r in jaccard.near_duplicates(odd(rows), bucket_rows=9).collect()} == whole
    named = odd(rows).selectExpr("concat('doc ', lpad(doc_id, 5, '0')) AS doc_id", "text", "doc_id AS id", "'x' AS value", "'y' AS key")
    assert {(int(r.doc_id[4:]), int(r.group_id[4:])) for r in jaccard.near_duplicates(named).collect()} == set(whole.items())


def test_components_of_a_long_chain(spark):
    edges = spark.range(3000).selectExpr("id * 7919 % 3001 AS x", "(id + 1) * 7919 % 3001 AS y")
    got = {r.node: r.root for r in graph.components(edges, "x", "y").collect()}
    assert set(got.values()) == {0} and len(got) == 3000


def test_pairs_across_groups():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 9, 63).astype(np.uint16) * np.ones((40, 1), np.uint16)
    sig[rng.random(sig.shape) < 0.1] = 99
    group = rng.integers(0, 4, 40)
    pairs = lambda found: {tuple(sorted((int(i), int(j)))) for i, others in found for j in others}
    every = pairs(jaccard.bucket_pairs(sig, 0.6, 0.001))
    assert every and pairs(jaccard.bucket_pairs(sig, 0.6, 0.001, group)) == {(i, j) for i, j in every if group[i] != group[j]}
    assert not pairs(jaccard.bucket_pairs(sig, 0.6, 0.001, np.zeros(40, int)))
    main = group == 2
    want = {(i, j) for i, j in every if group[i] != group[j] and (main[i] or main[j])}
    assert want and pairs(jaccard.bucket_pairs(sig, 0.6, 0.001, group, main, True)) == want
