"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token-id shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept.  All but the last return the columns of ``documents``.  A
stage's result must be written before the next stage of the same ``sf_dir``
begins, unless it is that stage's ``docs``: then what it was made from goes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import tokenizer_files
from lectern.llm.bitplanes import read_documents, write_shards
from lectern.llm.decontaminate import decontaminate
from lectern.llm.language_bloom import held_out, identify, thresholds, train
from lectern.llm.minhash_dedup import near_dedup
from lectern.llm.mixing import mixed_documents
from lectern.llm.workspace import Scratch, bound_batches, drop, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is in no known language if fewer of its n-grams are in the filter of the best; where no labelled row gives a threshold.
MIN_COVERAGE = 0.02
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_SCRATCH: dict[str, Scratch] = defaultdict(Scratch)


def _stage(run: Stage) -> Stage:
    """Bounds a stage's batches, and removes what earlier stages of the same input have stored and ``docs`` doesn't read."""

    @wraps(run)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        if staged is STAGES[0][1]:
            _SCRATCH[sf_dir] = Scratch()  # another run of the pipeline: what the last one made stays
        _SCRATCH[sf_dir].release(spark, docs)
        with _SCRATCH[sf_dir].collect():
            return run(spark, docs, sf_dir)

    return staged


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language, with the predicted one as ``lang``.

    The model and its thresholds come from all labelled rows.  Null texts and texts without a letter are in none and go.  Null ids and
    repeated rows are judged row by row.  Without labelled rows nothing is
    known, and all go.
    """
    model = train(docs.where(~held_out()), sample=None)
    known = thresholds(docs.where(held_out()), model)
    least = F.lit(MIN_COVERAGE)
    for name, value in known.items():
        least = F.when(F.col("lang_pred") == name, max(value, MIN_COVERAGE)).otherwise(least)
    found = identify(docs, model, keep=("text", "source", "n_chars"))
    good = found.where((F.col("lang_pred") != "und") & (F.col("coverage") >= least))
    return good.withColumnRenamed("lang_pred", "lang").select(COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more.

    Texts without words are in no group and stay.  Rows that share an id are
    one document and stay or go together.  Rows with a null id have no place
    among the groups' representatives, and all stay.
    """
    gone = near_dedup(docs, width=5, percent=80).where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs.

    Rows that share an id go together.  Rows with a null id are judged by their
    texts.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    hit = found.where("n_hit > 0").select("doc_id").distinct()
    named = docs.join(hit, "doc_id", "left_anti").select(COLUMNS)
    unnamed = docs.where("doc_id IS NULL")
    if unnamed.isEmpty():
        return named
    # texts that are hit, by digest, for the rows that no id tells apart
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = unnamed.select(own.alias("doc_id"), "text").distinct()
    bad = decontaminate(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10).where("n_hit > 0").select(F.col("doc_id").alias("_digest"))
    kept = unnamed.withColumn("_digest", own).join(bad, "_digest", "left_anti").select(COLUMNS)
    return named.where("doc_id IS NOT NULL").unionByName(kept)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, shard by shard: a row for each piece of a document that a block of a shard holds.

    Null ids and repeated rows are mixed like all others; null and blank texts
    have no words and so no rows.
    """
    return mixed_documents(docs.select(COLUMNS))


@_stage
def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stores the shards and returns what they hold of each row.

    Null texts are empty, and each row has at least its end id.  Null ids come
    first; rows that share an id are rows of their own.
    """
    return read_documents(spark, write_shards(docs, tokenizer_files.path("word_bpe_49k.json"), end_id=2))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("token-ID output", token_id_output),
]

#: SQL can't express the language model, the signatures or the draws.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
