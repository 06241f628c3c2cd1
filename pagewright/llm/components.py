"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the least node around that node."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour smaller than a node, and the node, are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)``, two bigints -> ``(a, b)``: each node but a component's least with that least node.

    Only grouped minima and equi-joins run, so no component's members meet in one task and nothing is
    collected; every round ends in a table of the shared folder. Self-edges and repeats do no harm, an
    empty table gives an empty result, rows with a null end are left out. Raises if the rounds run out.
    """
    now = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = _sum(now)
    if not before[0]:
        return now
    for _ in range(max_rounds):
        now = saved(_small_star(_large_star(now)), "edges")
        after = _sum(now)
        if after == before:
            return now
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
