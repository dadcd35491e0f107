"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.llm.stage import discard, stored


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _oriented(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return _oriented(linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` pairs of integer nodes to ``node, component``: the smallest node reachable, for every node that is not it itself.

    Minima are aggregated before they move and joins are left to skew handling, so a node with very many neighbours is no
    hot group. Each round is written to the shared folder; rounds end when a round changes no edge. No edges give no rows.
    """
    now, before = stored(_oriented(edges), "edges"), None
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
        if before is not None:
            discard(before)
        before, now = now, stored(_small_star(_large_star(now)), "edges")
    discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
