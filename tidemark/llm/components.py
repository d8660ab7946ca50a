"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _least(edges: DataFrame, at: str, other: str) -> DataFrame:
    """The least neighbour of each node; a partial aggregate first, so hubs are cheap."""
    return edges.groupBy(at).agg(F.min(other).alias("__m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "a", "b").select("a", F.least("a", "__m").alias("__m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("__m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    joined = down.join(_least(down, "a", "b"), "a")
    moved = joined.where("b <> __m").select(F.col("b").alias("a"), F.col("__m").alias("b"))
    kept = joined.select("a", F.col("__m").alias("b"))
    return moved.unionByName(kept).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; component is the least node.

    Each round writes its links to the checkpoint folder, and only two numbers
    reach the driver. A hub's links meet in a min() that combines before the
    shuffle and in an equi join that adaptive execution may split. An empty
    table, self links and repeated links are fine; nulls must not occur.
    Raises if ``max_rounds`` do not suffice (they grow with the logarithm of
    the longest chain), so no link is lost silently.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"))
    mark = None
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)))
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(centres)
