"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted, stage_table


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set; one row reaches the driver."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return salted(both.filter("v > u"), least, "u", "v", n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges have v < u. Every u keeps its least neighbour m; the other neighbours are hung on m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = salted(edges, least, "u", "v", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    edges: columns u, v of long; direction, loops and repeats don't matter. Each round is two aggregations with map-side
    combining and two joins on u, in which a node of many edges is dealt over several tasks; rounds grow with the logarithm of
    the node count. Each star is written to the shared folder. Without edges the result is empty."""
    now = stage_table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        large = stage_table(_large_star(now, mark[0]), "stars")
        new = stage_table(_small_star(large, mark[0]), "edges")
        discard(large)
        after = _mark(new)
        if after == mark:
            roots = new.select(F.col("v").alias("node")).distinct()
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        discard(now)
        now, mark = new, after
