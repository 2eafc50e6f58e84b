"""Corpus state without row updates: every change is a classification and a rebuilt table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

REASON_LIMIT = 2000


def classify(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """external_id and action: insert, replace, unchanged or absent.

    current: external_id, sha256, parser, status; incoming: external_id,
    sha256, parser.  Unchanged: the same content by the same parser, stored
    well.  A parser's fallback form ("hybrid:...") counts as that parser.
    """
    old = current.select("external_id", F.col("sha256").alias("o_sha"), F.substring_index("parser", ":", 1).alias("o_parser"), F.col("status").alias("o_status"))
    both = old.join(incoming.select("external_id", "sha256", F.substring_index("parser", ":", 1).alias("parser")), "external_id", "full")
    same = (F.col("sha256") == F.col("o_sha")) & (F.col("parser") == F.col("o_parser")) & (F.col("o_status") == "ok")
    action = F.when(F.col("o_sha").isNull(), "insert").when(F.col("sha256").isNull(), "absent").when(same, "unchanged").otherwise("replace")
    return both.select("external_id", action.alias("action"))


def to_parse(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """What must be parsed: incoming rows that aren't unchanged, told before any parsing."""
    done = current.where("status = 'ok'").select("external_id", "sha256", F.substring_index("parser", ":", 1).alias("parser"))
    return incoming.join(done, ["external_id", "sha256", "parser"], "left_anti")


def merged(current: DataFrame, parsed: DataFrame) -> DataFrame:
    """The new papers table: parsed rows replace theirs whole, failed ones are quarantined with a reason.

    current: external_id, sha256, parser, status, reason; parsed: external_id, sha256, parser, error.
    """
    new = parsed.select("external_id", "sha256", "parser", F.when(F.col("error").isNull(), "ok").otherwise("quarantined").alias("status"), F.left("error", F.lit(REASON_LIMIT)).alias("reason"))
    return current.join(new, "external_id", "left_anti").select("external_id", "sha256", "parser", "status", "reason").unionByName(new)


def structure_of(papers: DataFrame) -> dict[str, DataFrame]:
    """sections, paragraphs, tables and edges of parsed papers, with ids that follow from natural keys."""
    paper = papers.where("error IS NULL").withColumn("paper_id", F.xxhash64("external_id"))
    section = paper.select("paper_id", F.explode("sections").alias("s")).withColumn("section_id", F.xxhash64("paper_id", F.lit("section"), "s.ordinal"))
    paragraph = section.select("paper_id", "section_id", F.explode("s.paragraphs").alias("p"))
    table = paper.select("paper_id", F.explode("tables").alias("t"))
    edge = paper.select(F.col("paper_id").alias("src_paper_id"), F.explode("references").alias("r"))
    return {
        "sections": section.select("paper_id", "section_id", "s.heading", "s.ordinal", "s.depth", "s.kind"),
        "paragraphs": paragraph.select("paper_id", "section_id", F.xxhash64("section_id", F.lit("paragraph"), "p.ordinal").alias("paragraph_id"), "p.ordinal", "p.text", "p.page_from", "p.page_to"),
        "tables": table.select("paper_id", F.xxhash64("paper_id", F.lit("table"), "t.ordinal").alias("table_id"), "t.*"),
        "edges": edge.select(F.xxhash64("src_paper_id", F.lit("edge"), "r.ordinal").alias("edge_id"), "src_paper_id", "r.*"),
    }


def without(rows: DataFrame, gone: DataFrame, key: str = "paper_id") -> DataFrame:
    """The rows that stay when their owners go."""
    return rows.join(gone.select(key), key, "left_anti")


def replace_fingerprint(chunks: DataFrame, path: str) -> None:
    """Overwrite the stored chunks of the fingerprints in ``chunks`` and no others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_fingerprint").parquet(path)


def add_missing(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Insert or ignore."""
    return current.unionByName(rows.join(current.select(key), key, "left_anti").select(current.columns))
