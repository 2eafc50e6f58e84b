"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import drop, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("n")))
    ends = ends.groupBy("k").agg(F.sum("n").alias("as_u"), F.min("n").alias("least"))
    return ends.where("as_u > 1 OR (as_u > 0 AND least = 0)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): component is the least id that can be reached.

    links: two bigint columns ``a`` and ``b``; order, repeats and loops do not
    matter, and a row with a null is no link.  Only ids with a link to another
    id are returned.  A vertex of any degree is fine: its neighbours are
    summarised by a minimum, and no list of them is built.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(_small_star(edges), "edges")
    while not _settled(edges):
        new = materialize(_small_star(_large_star(edges)), "edges")
        drop(edges)
        edges = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
