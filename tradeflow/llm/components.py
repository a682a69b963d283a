"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of every node to the least of node and neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every node with a smaller node in its component; root is the smallest.

    `edges` are pairs (u, v) of longs. Each round writes its edges, about as many as
    there are nodes, and ends when every edge leads to a root; rounds grow with the
    logarithm of the longest chain.
    """
    now = staged(edges.filter("u != v").distinct(), "edges")
    before = None
    while True:
        now = staged(_small_star(_large_star(now)).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select("u", F.col("v").alias("root"))
        before = state
