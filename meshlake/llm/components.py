"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a grouped minimum (combined map-side) and an equi-join, so a node with very many edges is pre-aggregated
before the shuffle and its rows can be split by adaptive execution. Edges never reach the driver, only two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`edges` (a, b: bigint) to (node, root): every node that has an edge and isn't its component's least node.

    Empty input gives an empty table; loops and repeated edges don't matter; edges with a null end are ignored. A round reads
    its edges twice, so `edges` is kept as a table first: spanning forests that come out otherwise when they are computed again
    would lose links.
    """
    edges = kept(edges.select("a", "b").where("a != b").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        edges = kept(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
