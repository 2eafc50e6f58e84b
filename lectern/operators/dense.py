"""Exact nearest neighbours by distance, in one plan for all queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, d: s + d))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, d: s + d)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def unit(vector: Column) -> Column:
    """The vector at length 1, in double precision; null for a zero vector."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size))


def nearest(queries: DataFrame, vectors: DataFrame, *, top_k: int = 5, batch: int = 5000, measure=l2) -> DataFrame:
    """(query_id, vec_id, distance, rank) of the nearest vectors, another id than the query's.

    A stated query set against all rows: each block of at most ``batch``
    queries is broadcast, and the vectors are read once a block; every block
    keeps top_k rows a query.  Ties go to the lesser id.
    """
    n = queries.count()
    blocks = max(1, -(-n // batch))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    out = None
    for k in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        pairs = vectors.join(F.broadcast(own.select("query_id", F.col("embedding").alias("q"))), F.expr("vec_id <> query_id"))
        ranked = pairs.select("query_id", "vec_id", measure(F.col("embedding"), F.col("q")).alias("distance")).withColumn("rank", F.row_number().over(order))
        ranked = ranked.where(F.col("rank") <= top_k)
        out = ranked if out is None else out.unionByName(ranked)
    return out
