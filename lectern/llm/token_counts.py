"""Token counts through a digest cache.

A stored table maps (content digest, tokenizer digest) to a count.  The
documents' distinct digests are joined with it, without their texts; only the
contents that it lacks are brought, each once, encoded, and their counts
appended to it before the result is read from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .textbytes import text_buffer
from .tokenizing import encoder, file_digest
from .workspace import materialize, new_path

#: Slots of the filter with which texts are chosen before they are shuffled: its table has so many rows at most.
SLOTS = 1 << 20
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = encoder(path).counts(*text_buffer(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def _read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cache's rows of one tokenizer version; a cache that isn't there is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache) if fs.exists(path) else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, *, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    cache: the folder of the stored counts, shared by runs; without one, the
    run has a cache of its own, and so encodes every distinct content once.
    The content is normalised before its digest is taken: null becomes the
    empty text, which has no tokens.  Nothing else is normalised, since any
    change of a text may change its count.  Ids may be null or repeat: each
    row is counted.  Two runs that append the same content at once leave two
    equal rows, which count as one.  Other columns of ``docs`` play no part.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-counts")
    version = file_digest(tokenizer_path)
    content = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest")

    distinct = docs.select(digest).distinct()
    found = materialize(distinct.join(_read_cache(spark, cache, version), "digest", "left"), "found-counts")
    missing = found.where("n_tokens IS NULL").select("digest")
    if not missing.isEmpty():
        slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).alias("slot")
        slots = F.broadcast(missing.select(slot).distinct())  # at most SLOTS rows
        texts = docs.select(digest, content.alias("text")).withColumn("slot", slot).join(slots, "slot", "left_semi").select("digest", "text")
        misses = texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
        counted = misses.mapInArrow(_count(tokenizer_path), "digest binary, n_tokens bigint")
        counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
        fresh = missing.join(_read_cache(spark, cache, version), "digest")
        found = materialize(found.where("n_tokens IS NOT NULL").unionByName(fresh), "all-counts")

    # both sides are plain, so that the join can be split where many rows share a digest
    keyed = docs.select(F.col(id_col).alias("id"), F.octet_length(content).cast("bigint").alias("n_bytes"), digest)
    out = keyed.join(found, "digest", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
