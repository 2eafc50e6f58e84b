"""Development and holdout isolation. A paper without a split row is in no view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dev_only(rows: DataFrame, split: DataFrame | Column, include_holdout: bool = False) -> DataFrame:
    """Rows (with paper_id) of the development split; with ``include_holdout`` of both splits.

    split: the split table, or, where the rows tell it, a column of theirs; then nothing is joined.
    """
    if isinstance(split, Column):
        return rows.where(F.col("paper_id").isNotNull() & (split.isin("dev", "holdout") if include_holdout else split == "dev"))
    wanted = split if include_holdout else split.where("split = 'dev'")
    return rows.join(wanted.select("paper_id"), "paper_id", "left_semi")


def set_split(current: DataFrame, holdout_ids: DataFrame, papers: DataFrame) -> DataFrame:
    """The rebuilt split table: named papers are held out, others are dev; the first frozen_at stays."""
    marked = papers.join(holdout_ids.select(F.col("id").alias("external_id"), F.lit(True).alias("_held")), "external_id", "left")
    split = F.when(F.col("_held"), "holdout").otherwise("dev")
    rows = marked.select("paper_id", split.alias("split")).join(current.select("paper_id", F.col("frozen_at").alias("_at")), "paper_id", "left")
    return rows.select("paper_id", "split", F.coalesce("_at", F.current_timestamp()).alias("frozen_at"))


def unassigned(papers: DataFrame, split: DataFrame) -> DataFrame:
    return papers.join(split, "paper_id", "left_anti")


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("n"))
