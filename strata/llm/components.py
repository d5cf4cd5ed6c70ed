"""Connected components of an edge table by alternating star operations.

Each round replaces every edge by edges to the smallest known neighbour (large star,
then small star) until nothing changes; the number of rounds grows with the
logarithm of the longest chain. A node's least neighbour reaches its edges by parts of
them, so that the centre of a large star is no task of its own. Rounds are reliable
checkpoints, and only two sums per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import attach, cut


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): edges with the least ``b`` of all edges of their ``a``."""
    return attach(edges, "a", "b", [F.min("b").alias("m")], [F.min("m").alias("m")])


def _large_star(edges: DataFrame) -> DataFrame:
    both = _with_least(edges.union(edges.select("b", "a")))
    return both.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return down.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component."""
    now = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (sums["n"], sums["h"]) == state or not sums["n"]:
            break
        state = (sums["n"], sums["h"])
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
