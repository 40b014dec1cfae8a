"""Connected components by alternating star contraction on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumloom.session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of ids -> (id, component), component = smallest id reachable; ids without edges are left out.

    Each round is two grouped minima and two equi-joins; the rows are written out once per round. It ends
    when no target points on and no id has two targets, whatever number of rounds that takes; links that are
    stars around their smallest id need none.
    """
    low, high = F.least("a", "b").cast("bigint"), F.greatest("a", "b").cast("bigint")
    current = settle(edges.where("a != b").select(high.alias("a"), low.alias("b")).distinct())
    while True:
        on = current.select(F.col("b").alias("a")).distinct().join(current, "a", "left_semi").limit(1)
        twice = current.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").limit(1)
        if on.unionAll(twice).isEmpty():
            break
        current = settle(_small_star(_large_star(current)))
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
