"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainsieve.llm.store import discard, written


def _stamp(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node of an edge but the roots.

    Each round is a few shuffles of the edge list, written to the shared folder; rounds grow
    with the logarithm of a component's diameter and go on until nothing changes. Loops and null ends are dropped.
    """
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    pairs = written(pairs, "edges")
    before = _stamp(pairs)
    near = Window.partitionBy("u")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(near))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.withColumn("m", F.min("v").over(near))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, pairs = pairs, written(small, "edges")
        discard(pairs.sparkSession, old)
        after = _stamp(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
