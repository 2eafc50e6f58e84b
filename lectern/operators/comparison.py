"""Comparison tables, parser reports and contradictions over extracted records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def comparison_table(records: DataFrame, fields: list[str]) -> DataFrame:
    """records (paper_id, field, value) with a column for each field."""
    return records.where(F.col("field").isin(fields)).groupBy("paper_id").pivot("field", fields).agg(F.max("value"))


def parser_report(measures: DataFrame, parsers: list[str]) -> DataFrame:
    """measures (parser, metric, value) as medians, a column for each parser."""
    return measures.groupBy("metric").pivot("parser", parsers).agg(F.median("value"))


def contradictions(records: DataFrame, setup: list[str], tolerances: DataFrame) -> DataFrame:
    """Pairs of papers that report unlike values for the same metric in the same setup.

    records: paper_id, metric, value, and the setup columns; a record with a
    null among them is left out.  tolerances: metric, kind (absolute or
    relative), tolerance.  Per setup and paper, equal values meet once; pairs
    are of a setup's distinct values, found in their order: only where the
    setup's least and greatest values are apart is anything paired.
    """
    keys = ["metric", *setup]
    rows = records.dropna(subset=["paper_id", "value", *keys]).join(tolerances, "metric")
    limit = F.when(F.col("kind") == "relative", F.col("tolerance") * F.greatest(F.abs("low"), F.abs("high"))).otherwise(F.col("tolerance"))
    span = rows.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max("kind").alias("kind"), F.max("tolerance").alias("tolerance"))
    apart = span.where(F.col("high") - F.col("low") > limit).select(*keys)
    left = rows.join(apart, keys, "left_semi").select(*keys, "kind", "tolerance", F.col("paper_id").alias("paper_a"), F.col("value").alias("value_a")).distinct()
    right = rows.select(*keys, F.col("paper_id").alias("paper_b"), F.col("value").alias("value_b")).distinct()
    gap = F.abs(F.col("value_a") - F.col("value_b"))
    allowed = F.when(F.col("kind") == "relative", F.col("tolerance") * F.greatest(F.abs("value_a"), F.abs("value_b"))).otherwise(F.col("tolerance"))
    return left.join(right, keys).where((F.col("paper_a") < F.col("paper_b")) & (gap > allowed)).select(*keys, "paper_a", "paper_b", "value_a", "value_b")
