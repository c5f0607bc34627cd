"""Connected components of an edge table, by star contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batida.llm.common import materialize

SALTS = 64  # parts that the edges of a node are dealt into


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    return row[0], row[1]


def with_least(edges: DataFrame) -> DataFrame:
    """edges (a, b) with m, the least b of each a.

    A hub's edges are dealt into SALTS parts: their minima meet in one row per
    part, and each part joins its own, so no task gets all edges of a node.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = dealt.groupBy("a", "part").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"))
    return dealt.join(parts.select("a", "part").join(least, "a"), ["a", "part"]).drop("part")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (a, b: long).

    Each turn links a node's larger neighbours to its least neighbour, then
    the smaller ones; edges become stars in about log(n) turns. Every turn is
    written to the shared folder in place of the one before. Loops and repeated edges are dropped.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    down = materialize(down)
    before = _mark(down)
    while True:
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = with_least(large).select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        down = materialize(small.distinct(), instead_of=down)
        after = _mark(down)
        if after == before:
            break
        before = after
    roots = down.select(F.col("b").alias("node")).distinct()
    return down.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
