"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that an edge (a, b) names.

    Alternating large-star and small-star steps, which end after about log(n) rounds. A node
    never gathers its neighbours: each step takes the minimum of a group with map-side
    combining and joins it back, so a hub with many edges is an ordinary skewed join, which
    adaptive execution splits. Every round is checkpointed in the shared folder.

    Self loops and repeated edges don't matter; an empty table gives an empty result.
    """
    current = checkpointed(
        edges.where(~F.col("a").eqNullSafe(F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(ROUNDS):
        large = _star(current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        small = checkpointed(_star(large, False))
        # A set of stars no longer changes; count and sums tell one state from the next.
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        current = small
        if state == before:
            stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return stars.unionByName(roots)
        before = state
    raise RuntimeError("connected components did not settle")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on directed edges (a, b): link b to the least of a and its neighbours, where b > a (large) or b <= a (small)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    if large:
        linked = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()
