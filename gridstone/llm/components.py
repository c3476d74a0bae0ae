"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import apart, removed, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable from node; nodes without edges are not listed.

    ``edges`` has columns a and b of one orderable type. Each round hooks the neighbours of a node to its smallest one,
    with grouped minima and one join, and is written to the shared folder. A hub's edges are summed before the shuffle,
    and the join is free to split it; it is a merge, as no side is small for sure.
    """
    spark = edges.sparkSession
    e, at = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), True)
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(apart(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large, large_at = written(large, True)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(apart(low), "a")
        last = at
        e, at = written(pairs.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y"))).where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), True)
        removed(spark, last, large_at)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
