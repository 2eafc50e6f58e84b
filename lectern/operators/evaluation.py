"""Retrieval evaluation at paper level: all questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import metrics

QUESTION_TYPES = ("single_hop", "multi_hop", "comparison", "definition", "numeric", "unanswerable")
OVER_FETCH = 4


def gold_gains(gold: DataFrame) -> DataFrame:
    """query_id, relevant (ids), gains (map): of several rows of a paper the last (by ``pos``) holds."""
    last = gold.groupBy("query_id", "paper_id").agg(F.max_by("relevance", "pos").alias("relevance"))
    pairs = F.array_sort(F.collect_list(F.struct("paper_id", "relevance")))
    return last.groupBy("query_id").agg(F.map_from_entries(pairs).alias("gains")).withColumn("relevant", F.map_keys("gains"))


def per_question(questions: DataFrame, ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """query_id, type, recall, precision, hit, rr, ndcg for the answerable questions.

    questions: query_id, type; ranked: query_id, paper_id, rank; gold: ``gold_gains``.
    A question with no hits scores 0.
    """
    return judged(questions.join(gold, "query_id"), ranked, k)


def judged(questions: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """``per_question`` for questions that have their gold beside them: query_id, type, relevant, gains."""
    order = F.array_sort(F.collect_list(F.struct("rank", "paper_id")))
    lists = ranked.groupBy("query_id").agg(order["paper_id"].alias("found"))
    rows = questions.where("type <> 'unanswerable'").join(lists, "query_id", "left")
    found, relevant = F.coalesce("found", F.array().cast("array<bigint>")), F.col("relevant")
    rows = rows.select("query_id", "type", found.alias("found"), "relevant", "gains")
    found = F.col("found")
    return rows.select(
        "query_id", "type", metrics.recall(found, relevant, k).alias("recall"), metrics.precision(found, relevant, k).alias("precision"), metrics.hit(found, relevant, k).alias("hit"),
        metrics.reciprocal_rank(found, relevant).alias("rr"), metrics.ndcg(found, F.col("gains"), k).alias("ndcg"),
    )


def summary(scored: DataFrame) -> DataFrame:
    """scope (overall or a type), n, and means; precision only overall."""
    names = ["recall", "precision", "hit", "rr", "ndcg"]
    means = scored.groupingSets([[], [F.col("type")]], F.col("type")).agg(F.grouping("type").alias("g"), F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names])
    scope = F.when(F.col("g") == 1, "overall").otherwise(F.col("type")).alias("scope")
    return means.select(scope, "n", *[(F.when(F.col("g") == 1, F.col(c)) if c == "precision" else F.col(c)).alias(c) for c in names])


def type_histogram(questions: DataFrame, types: tuple[str, ...] = QUESTION_TYPES) -> DataFrame:
    """A row for each type of the domain: n (0 where absent) and a warning (none or few questions)."""
    spark = questions.sparkSession
    domain = spark.createDataFrame([(t,) for t in types], "type string")
    counts = questions.groupBy("type").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    rows = F.broadcast(domain).join(counts, "type", "left").select("type", n.cast("bigint").alias("n"))
    return rows.withColumn("warning", F.when(F.col("n") == 0, "no questions").when(F.col("n") < 3, "fewer than 3 questions"))


def size_warning(questions: DataFrame, least: int = 60) -> DataFrame:
    return questions.agg(F.count("*").alias("n")).select("n", F.when(F.col("n") < least, F.lit(f"fewer than {least} questions")).alias("warning"))
