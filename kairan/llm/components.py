"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

#: Rounds after which a graph that still changes is reported as an error rather than answered wrongly.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star (or small star): link each node's greater (or smaller) neighbours to its least neighbour.

    The least neighbour is an aggregate that is joined back, so the neighbours of a node never meet in one task's
    memory; Spark splits the join of a node with very many of them.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = both.join(least, "u")
    out = near.filter("v > u") if large else near.select(F.col("v"), "m").union(least.select(F.col("u").alias("v"), "m"))
    return out.select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least reachable node) of each node of ``edges`` (``a``, ``b``; any direction).

    Alternating large and small stars (Kiveris et al. 2014), each round written to the shared folder. Self-links,
    repeated and null edges don't matter; nodes without an edge to another node don't appear.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), *(F.coalesce(F.sum(F.xxhash64("a", "b", F.lit(i)) % 1_000_000_007), F.lit(0)) for i in (1, 2))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before, last = state, now
        now = stored(_star(_star(now, True), False), "edges")
        release(last)
    raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
