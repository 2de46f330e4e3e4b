"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is a map-side combined minimum and a join of each vertex's edges with that minimum. Vertices with very many
neighbours get it by broadcast (a bounded number of rows), so the members of a large group don't meet in one task. Nothing
but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_each


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n")).filter("n > 0")
    return join_each(both.filter("v > u"), least, ["u"], "n", n_edges).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    down = edges.filter("v < u")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_each(down, least, ["u"], "n", n_edges).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """edges(u long, v long) -> (node, component): each vertex of an edge with the smallest vertex it reaches.

    Self loops, repeated edges and nulls are ignored; vertices without edges get no row; an empty table gives none.
    """
    e = edges.select("u", "v").filter("u <> v")
    e = scratch.save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    for _ in range(most_rounds if before[0] else 0):
        large = scratch.save(_large_star(e, before[0]))
        new = scratch.save(_small_star(large, before[0]))
        scratch.drop(e)
        scratch.drop(large)
        e, after = new, mark(new)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("connected components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
