"""Connected components of a distributed edge list, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.runtime import discard, materialise

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest one."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that an edge names; ``root`` is its component's least node.

    Edges may repeat, run either way or be loops; nulls are dropped.  Each round
    shuffles the surviving edges, whose number never grows beyond the input's,
    and rounds grow with the logarithm of the longest path.  The rounds go on
    until the edges form stars, so the result is exact.
    """
    a, b = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = materialise(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        last, now = now, materialise(_small_star(_large_star(now)))
        discard(last)
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == state:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
        state = found
    raise RuntimeError("the components did not settle")
