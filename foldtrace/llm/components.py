"""Connected components of a graph given as an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rounds are logarithmic in the longest path; reaching this means the input changed meanwhile.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges (a, b).

    Alternating large-star and small-star rounds: every round is two aggregations by node, and
    its result is written to the shared folder.  A hub costs one aggregated row per task.
    """
    pairs = stored(_tidy(edges.select("a", "b")), "links")
    for _ in range(MAX_ROUNDS):
        after = stored(_star(_star(pairs, large=True), large=False), "links")
        changed = after.exceptAll(pairs).limit(1).count() or pairs.exceptAll(after).limit(1).count()
        pairs = after
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    # Settled: every node has one edge, to the least node of its component.
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(pairs.select("b", "b").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """Edges from the greater to the lesser node, each once."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Join each node's greater (large) or lesser (small) neighbours to its least neighbour."""
    ways = pairs.union(pairs.select("b", "a").toDF("a", "b")) if large else pairs
    least = ways.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
    joined = ways.join(least, F.col("a") == F.col("n"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return _tidy(moved)
    moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _tidy(moved.union(joined.select("a", "low").toDF("a", "b")))
