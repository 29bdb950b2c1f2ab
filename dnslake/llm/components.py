"""Connected components of a graph of any size, by alternating star contractions.

Each round replaces edges by edges to the smallest known neighbour: first from larger neighbours (large
star), then among smaller ones (small star).  Both steps are one aggregation and one join; a hub's
neighbours are combined before the shuffle, and nothing is gathered per group.  The number of rounds
grows with the logarithm of the longest path.  Rounds are cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dnslake.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of the component.

    ``edges`` has columns a and b; edges with nulls and self-edges are ignored, repeated ones count once.
    """
    edges = cut_lineage(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
