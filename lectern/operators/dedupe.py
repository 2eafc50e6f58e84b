"""Duplicates by identity keys, and the import plan that keeps them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import loose_title, title_key


def duplicate_groups(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Keys that occur more than once, with their counts; null and empty keys are none."""
    keyed = rows.select(key.alias(name)).where(F.col(name).isNotNull() & (F.col(name) != ""))
    return keyed.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def cross_split_titles(papers: DataFrame, split: DataFrame, title_col: str = "title") -> DataFrame:
    """(dev_id, holdout_id, key): titles that are equal without case and punctuation on both sides of the split.

    A paper without a split is on no side.
    """
    keyed = papers.join(split, "paper_id").select("paper_id", "split", loose_title(F.col(title_col)).alias("key")).where("key <> ''")
    dev = keyed.where("split = 'dev'").select(F.col("paper_id").alias("dev_id"), "key")
    held = keyed.where("split = 'holdout'").select(F.col("paper_id").alias("holdout_id"), "key")
    return dev.join(held, "key").select("dev_id", "holdout_id", "key")


def import_plan(batch: DataFrame, known: DataFrame, excluded: DataFrame) -> DataFrame:
    """batch with action (add, skip or block) and reason, by the first rule that holds.

    batch: external_id, sha256, title, pos (its order); known: external_id,
    sha256, title, split; excluded: sha256.  In order: excluded content, known
    content, content earlier in the batch, known id, then the title's first
    eight words: blocked where the twin is held out, else skipped.
    """
    first = Window.partitionBy("sha256").orderBy("pos")
    rows = batch.withColumn("_seq", F.row_number().over(first)).withColumn("_key", title_key(F.col("title")))
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = rows.join(flag(excluded, "sha256", "_excluded"), "sha256", "left").join(flag(known, "sha256", "_known"), "sha256", "left").join(flag(known, "external_id", "_id"), "external_id", "left")
    twins = known.select(title_key(F.col("title")).alias("_key"), "split").where("_key <> ''").groupBy("_key").agg(F.max(F.col("split") == "holdout").alias("_held"))
    rows = rows.join(twins, "_key", "left")
    reason = (
        F.when(F.col("_excluded"), "excluded content").when(F.col("_known"), "known content").when(F.col("_seq") > 1, "repeated in batch").when(F.col("_id"), "known id")
        .when(F.col("_held"), "title twin is held out").when(F.col("_held").isNotNull(), "title twin is known")
    )
    rows = rows.withColumn("reason", reason)
    action = F.when(F.col("reason").isNull(), "add").when(F.col("reason") == "title twin is held out", "block").otherwise("skip")
    return rows.select(*batch.columns, action.alias("action"), "reason")


def apply_import(plan: DataFrame, manifest: DataFrame, provenance: DataFrame, *, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The manifest and the provenance with a plan's additions; written only where a folder is given.

    plan: ``import_plan``; manifest: external_id, sha256, title; provenance:
    external_id, sha256, action, reason.  Without a folder nothing is touched:
    a dry run.  The new tables go beside the old ones, as ``manifest`` and
    ``provenance`` in a folder that isn't there yet.
    """
    added = plan.where("action = 'add'").select(*manifest.columns)
    told = plan.select(*provenance.columns)
    out = manifest.unionByName(added), provenance.unionByName(told)
    if folder is not None:
        for name, rows in zip(("manifest", "provenance"), out):
            rows.write.parquet(f"{folder}/{name}")
    return out
