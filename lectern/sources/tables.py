"""Parquet tables and the corpus views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Paragraphs that a paper may have: its ids are its own up to there, and more raise.
STRIDE = 1 << 24


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def papers(documents: DataFrame) -> DataFrame:
    """Documents as papers: paper_id, external_id, sha256, text, source."""
    text = F.col("text")
    return documents.select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("external_id"), F.sha2(text.cast("binary"), 256).alias("sha256"), "text", "lang", "source")


def split_of(paper_id: Column) -> Column:
    """The frozen split of the fixture: every third id is held out."""
    return F.when(paper_id % 3 == 0, "holdout").otherwise("dev")


def splits(documents: DataFrame) -> DataFrame:
    """``split_of`` as a table."""
    return documents.select(F.col("doc_id").alias("paper_id"), split_of(F.col("doc_id")).alias("split"))


def paragraphs(papers: DataFrame, section_size: int = 5) -> DataFrame:
    """Lines that aren't blank, in order: paper_id, section_id, paragraph_id, ordinal, text.

    Ids follow from the paper's id and the ordinal, so that they are the same
    in every run. Sections are blocks of ``section_size`` paragraphs.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = papers.select("paper_id", F.posexplode(lines).alias("place", "text"))
    ordinal = F.when(F.col("place") < STRIDE, F.col("place")).otherwise(F.raise_error(F.lit(f"a paper has more than {STRIDE} paragraphs")).cast("int"))
    rows = rows.select("paper_id", ordinal.alias("ordinal"), "text")
    base = F.col("paper_id") * STRIDE
    return rows.select("paper_id", (base + F.floor(F.col("ordinal") / section_size)).alias("section_id"), (base + F.col("ordinal")).alias("paragraph_id"), "ordinal", "text")
