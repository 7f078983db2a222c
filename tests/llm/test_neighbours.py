"""Nearest neighbours (1) against brute force."""

import os

import numpy as np
import pytest

from grainsieve.llm import neighbours


def brute(x, k):
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    np.fill_diagonal(d, np.inf)
    return d, np.argsort(d, 1, kind="stable")[:, :k]


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r.vec_id, []).append((r.neighbour, r.distance))
    return out


def test_recall_over_several_shards(spark):
    x = np.random.default_rng(0).normal(size=(1500, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, id string")
    got = found(neighbours.nearest(df, shard_rows=400))
    d, near = brute(x, 10)
    assert len(got) == 1500 and all(len(v) == 10 for v in got.values())
    assert np.mean([len({n for n, _ in got[i]} & set(near[i].tolist())) / 10 for i in range(1500)]) >= 0.9
    for i in range(0, 1500, 97):
        assert all(abs(dist - d[i, n]) < 1e-3 for n, dist in got[i])


def test_ties_copies_and_odd_rows(spark):
    copies = [(i, [1.0, 2.0, 3.0]) for i in range(100)]
    rows = [*copies, (200, [1.0, 2.0, 4.0]), (200, [1.0, 2.0, 4.0]), (201, None), (202, []), (203, [float("nan"), 0.0, 0.0]), (204, [1.0]), (None, [1.0, 2.0, 3.0]), (205, [None, 1.0, 2.0])]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert set(got) == {*range(100), 200}
    assert [n for n, _ in got[50]] == list(range(10)) and [n for n, _ in got[3]] == [0, 1, 2, *range(4, 11)]
    assert all(dist == 0 for _, dist in got[7]) and [round(dist, 6) for _, dist in got[200]] == [1.0] * 10


def test_small_and_empty_tables(spark):
    schema = "vec_id int, embedding array<double>"
    assert neighbours.nearest(spark.createDataFrame([], schema)).collect() == []
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0])], schema)).collect() == []
    two = neighbours.nearest(spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], schema))
    assert [tuple(r) for r in two.orderBy("vec_id").collect()] == [(1, 1, 2, 5.0), (2, 1, 1, 5.0)]
    assert dict(two.dtypes)["neighbour"] == "int"


def test_ids_of_any_type_and_vectors_of_several_sizes(spark):
    x = np.random.default_rng(1).normal(size=(60, 3))
    rows = [(f"row {i:03}", v.tolist()) for i, v in enumerate(x)] + [(f"wide {i}", [float(i), *v.tolist()]) for i, v in enumerate(x[:20])] + [(None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "vec_id string, embedding array<double>, id string, value string, dim int")
    out = neighbours.nearest(df, shard_rows=25)
    assert out.columns == ["vec_id", "rank", "neighbour", "distance"] and dict(out.dtypes)["neighbour"] == "string"
    got = found(out)
    _, near = brute(x, 10)
    assert all({n for n, _ in got[f"row {i:03}"]} == {f"row {k:03}" for k in near[i]} for i in range(60))
    assert len(got) == 80 and all(n.startswith("wide") for i in range(20) for n, _ in got[f"wide {i}"])
    some = found(neighbours.nearest(df, asked="vec_id = 'row 007'", slice_rows=1))
    assert some == {"row 007": got["row 007"]}
    assert neighbours.nearest(df, asked="vec_id > null").collect() == []


def test_query_recall(spark):
    from grainsieve.llm.queries import QUERIES

    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), [r.vec_id for r in rows]
    got = found(QUERIES["op1_nearest_neighbours"](spark, "/root/testdata/sf0.01"))
    _, near = brute(x, 10)
    asked = [p for p, i in enumerate(ids) if i % 50 == 0]
    assert np.mean([len({n for n, _ in got[ids[p]]} & {ids[k] for k in near[p]}) / 10 for p in asked]) >= 0.9
    assert set(got) == {ids[p] for p in asked} and asked


@pytest.mark.skipif(not os.path.exists("/root/testdata/check_l"), reason="no large table")
def test_recall_over_a_large_table(spark):
    """Every 50th of 51,000 vectors against all of them, over several shards."""
    df = spark.read.parquet("/root/testdata/check_l/embeddings.parquet").select("vec_id", "embedding")
    rows = df.toArrow()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy(zero_copy_only=False)).astype(np.float32)
    got = found(neighbours.nearest(df, asked="vec_id % 500 = 0"))
    asked = np.flatnonzero(ids % 500 == 0)
    norms = (x * x).sum(1)
    hits = []
    for p in asked:
        d = norms - 2 * (x @ x[p])
        d[p] = np.inf
        hits.append(len({n for n, _ in got[ids[p]]} & set(ids[np.argpartition(d, 10)[:10]].tolist())) / 10)
    assert len(got) == len(asked) and np.mean(hits) >= 0.9
