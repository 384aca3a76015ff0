"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, cut: Callable[[DataFrame], DataFrame], free: Callable[[DataFrame], None] = lambda _: None) -> DataFrame:
    """``node, component`` for every node of ``a, b``; the component is its smallest node. ``cut`` writes a table to the
    shared folder and reads it back, ``free`` removes one that a later round has replaced.

    Large stars hang a node's larger neighbours on its smallest one, small stars the smaller ones; they are done when
    every node hangs on one node that hangs on none. Minima are pre-aggregated and joined back, no neighbourhood is collected,
    and each round is written to the shared folder, so lineage stays short and a lost executor costs one round.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        before, edges = edges, cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        free(before)
        free(large)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _are_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    each = ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.max("holds").alias("h"))
    return each.filter("n > 1 OR n = 1 AND h = 1").isEmpty()
