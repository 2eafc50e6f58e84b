"""The corpus tables in Spark's catalog: create, migrate, verify."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Columns of the stored tables.
TABLES = {
    "papers": "paper_id bigint, external_id string, corpus_id string, sha256 string, parser string, status string, reason string, title string, year int, venue string, doi string, arxiv_id string",
    "sections": "paper_id bigint, section_id bigint, heading string, ordinal int, depth int, kind string",
    "paragraphs": "paper_id bigint, section_id bigint, paragraph_id bigint, ordinal int, text string, page_from int, page_to int",
    "chunks": "chunk_id bigint, paper_id bigint, section_id bigint, ordinal int, text string, strategy string, config_fingerprint string",
    "citation_edges": "edge_id bigint, src_paper_id bigint, dst_paper_id bigint, raw string, title string, doi string, arxiv_id string, how string",
    "corpus_split": "paper_id bigint, split string, frozen_at timestamp",
}
#: Views without held-out papers, and the tables they are over; a paper without a split is in none.
VIEWS = {"v_dev_papers": "papers", "v_dev_paragraphs": "paragraphs", "v_dev_chunks": "chunks"}


def _names(columns: str) -> dict[str, str]:
    return dict(c.split(" ") for c in columns.split(", "))


def create(spark: SparkSession, database: str) -> None:
    """All tables and views; what is there stays."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    for name, table in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT t.* FROM {database}.{table} t LEFT SEMI JOIN (SELECT paper_id FROM {database}.corpus_split WHERE split = 'dev') d ON t.paper_id = d.paper_id")


def migrate(spark: SparkSession, database: str) -> list[str]:
    """Add the columns that older tables lack; their names as table.column."""
    added = []
    for name, columns in TABLES.items():
        there = {c.name for c in spark.catalog.listColumns(f"{database}.{name}")}
        missing = {c: t for c, t in _names(columns).items() if c not in there}
        if missing:
            spark.sql(f"ALTER TABLE {database}.{name} ADD COLUMNS ({', '.join(f'{c} {t}' for c, t in missing.items())})")
            added += [f"{name}.{c}" for c in missing]
    if added:
        create(spark, database)  # views see the new columns
    return added


def verify(spark: SparkSession, database: str) -> list[str]:
    """What is missing or of another type; empty if all is there."""
    faults = []
    for name, columns in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            faults.append(f"no table {name}")
            continue
        there = {c.name: c.dataType for c in spark.catalog.listColumns(f"{database}.{name}")}
        faults += [f"{name}.{c} is {there.get(c, 'missing')}" for c, t in _names(columns).items() if there.get(c) != t]
    return faults + [f"no view {v}" for v in VIEWS if not spark.catalog.tableExists(f"{database}.{v}")]
