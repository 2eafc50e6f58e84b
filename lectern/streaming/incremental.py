"""Incremental ingest as a stream: an extension, the batch state operators over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import merged, to_parse

STATE = "external_id string, sha256 string, parser string, status string, reason string"


def documents_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def ingest(stream: DataFrame, state_folder: str, checkpoint: str) -> StreamingQuery:
    """Keep a papers table of versions below ``state_folder``; the newest version is the state.

    Each batch is merged into the version before it and written as a version
    of its own, named by the batch, so that a batch that is run again
    overwrites itself and nothing else.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(STATE).parquet(f"{state_folder}/v{number - 1}") if number else spark.createDataFrame([], STATE)
        text = F.coalesce("text", F.lit(""))
        incoming = batch.select(F.concat(F.lit("doc-"), "doc_id").alias("external_id"), F.sha2(text.cast("binary"), 256).alias("sha256"), F.lit("lines").alias("parser"), F.when(F.trim(text) == "", "no text").alias("error"))
        incoming = incoming.dropDuplicates(["external_id"])
        merged(before, to_parse(incoming, before)).write.mode("overwrite").parquet(f"{state_folder}/v{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed counts per event type with a watermark; the same on a stream and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
