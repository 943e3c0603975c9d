"""Connected components of a graph held as a DataFrame of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, stored

#: Rounds at most; stars need about the logarithm of the longest path.
ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its least one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to its least one. edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node of its component. edges: columns a, b of longs."""
    with Scratch(edges.sparkSession) as held:
        now = held.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        mark = None
        for _ in range(ROUNDS):
            before, now = now, held.stored(_small_star(_large_star(now)), "edges")
            held.drop(before)
            new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()  # one row
            if (new["n"], new["s"]) == mark:
                break
            mark = (new["n"], new["s"])
        else:
            raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
        return stored(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "roots")
