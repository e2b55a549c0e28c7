"""Connected components by alternating star contraction.

Each round links every node to the least node it knows, first over its larger
neighbours and then over its smaller ones, until the edges form stars. The number of
rounds grows with the logarithm of the longest path, each round is two aggregations
and two joins, and only whether the edges are stars reaches the driver. Edges that are stars take no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.sources.scratch import forget, materialise


def connected_components(edges: DataFrame, source: str = "source", target: str = "target", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the least node reachable.

    Direction, repeated edges and loops don't matter; edges with a null end are ignored.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.select(F.greatest(source, target).alias("a"), F.least(source, target).alias("b"), F.col(source).alias("s"), F.col(target).alias("t"))
    now = now.where(F.col("s").isNotNull() & F.col("t").isNotNull() & (a != b)).select("a", "b").distinct()
    now = materialise(now)
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
        before, now = now, materialise(small.select("e.a", "e.b").where(a != b).distinct())
        forget(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(a.alias("node"), b.alias("component")).unionByName(now.select(b.alias("node"), b.alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Do the edges (a, b), with b the lesser, form stars? Then no node with a lesser one stands in a second edge, and no round changes them."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("upper")), F.struct(F.col("b").alias("node"), F.lit(False).alias("upper")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.count(F.lit(1)).alias("n"), F.max("e.upper").alias("upper"))
    return not nodes.agg(F.max(F.col("upper") & (F.col("n") > 1))).first()[0]
