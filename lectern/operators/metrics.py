"""Retrieval and answer metrics as columns over arrays. Nothing to measure counts 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def recall(found: Column, relevant: Column, k: int) -> Column:
    top = F.slice(found, 1, k) if k > 0 else F.slice(found, 1, 0)
    return _share(F.size(F.array_intersect(top, relevant)), F.size(F.array_distinct(relevant)))


def precision(found: Column, relevant: Column, k: int) -> Column:
    """Of what was returned, up to k; not of k."""
    top = F.slice(found, 1, max(k, 0))
    return _share(F.size(F.filter(top, lambda x: F.array_contains(relevant, x))), F.size(top))


def hit(found: Column, relevant: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(found, 1, max(k, 0)), relevant), F.lit(False)).cast("double")


def reciprocal_rank(found: Column, relevant: Column) -> Column:
    """Of the first relevant one, wherever it is."""
    ranks = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda r: r.isNotNull())
    return _share(F.lit(1.0), F.array_min(ranks))


def dcg(gains: Column) -> Column:
    terms = F.transform(gains, lambda g, i: g / F.log2(i + F.lit(2)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def ndcg(found: Column, gains: Column, k: int) -> Column:
    """gains: a map from id to gain. The ideal is over all relevant ids; a repeated id counts again."""
    own = F.transform(F.slice(found, 1, max(k, 0)), lambda x: F.coalesce(gains[x], F.lit(0.0)))
    best = F.slice(F.sort_array(F.map_values(gains), asc=False), 1, max(k, 0))
    return _share(dcg(own), dcg(best))


def mean(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def answer_metrics(judged: DataFrame) -> DataFrame:
    """One row: citation_faithfulness, abstention_recall, false_refusal_rate.

    judged: entailed, answerable, abstained (booleans); a null is misaligned and raises.
    """
    row = judged.withColumn("_ok", F.assert_true(F.col("answerable").isNotNull() & F.col("abstained").isNotNull(), "misaligned judgements"))
    rate = lambda of, among: _share(F.count_if(of & among), F.count_if(among))
    yes = F.col("answerable")
    return row.where(F.col("_ok").isNull()).agg(
        mean(F.col("entailed").cast("double")).alias("citation_faithfulness"), rate(F.col("abstained"), ~yes).alias("abstention_recall"), rate(F.col("abstained"), yes).alias("false_refusal_rate")
    )
