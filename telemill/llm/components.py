"""Connected components of a graph given by its edges, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked with the least node among u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked with the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.

    edges: (u, v) of longs. Each round is written to the shared folder; the
    rounds end when a round changes nothing, after about the logarithm of the
    longest path. Neighbours are only joined and counted, never gathered.
    """
    edges = written(edges.where("u != v").select("u", "v").distinct())

    def mark(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    before = None
    now = mark(edges)
    while now != before and now[0]:
        edges = written(_small_star(_large_star(edges)))
        before, now = now, mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
