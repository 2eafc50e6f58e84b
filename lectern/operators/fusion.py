"""Rank fusion and rank-preserving lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def reciprocal_rank_fusion(rankings: list[DataFrame], *, k: int = 60, top_k: int = 5, weights: tuple[float, ...] | None = None, payload: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, the payload, score, rank) of rankings (query_id, chunk_id, rank): sums of weight / (k + rank); ties by chunk id.

    payload: columns that come from the copy with the best rank, of the first ranking among equals.
    """
    weights = weights or (1.0,) * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("a weight for each ranking is needed")
    named = [r.select("query_id", "chunk_id", "rank", *payload, F.lit(float(w)).alias("_w"), F.lit(i).alias("_i")) for i, (r, w) in enumerate(zip(rankings, weights))]
    every = reduce(DataFrame.unionByName, named)
    kept = [F.min_by(c, F.struct("rank", "_i")).alias(c) for c in payload]
    fused = every.groupBy("query_id", "chunk_id").agg(*kept, F.sum(F.col("_w") / (k + F.col("rank"))).alias("score"))
    # sums of the same terms in another order differ in their last bits
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def first_per_paper(hits: DataFrame, chunk_papers: DataFrame, top_k: int) -> DataFrame:
    """Hits as papers: each paper at its best rank, ranks contiguous again, the first ``top_k``."""
    return best_papers(hits.join(chunk_papers, "chunk_id"), top_k)


def best_papers(hits: DataFrame, top_k: int) -> DataFrame:
    """``first_per_paper`` of hits that have their paper_id."""
    best = hits.groupBy("query_id", "paper_id").agg(F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy("best", "paper_id")
    return best.select("query_id", "paper_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top_k)
