"""Checks over a whole corpus: exit criteria, frozen artifacts, citation precision, probes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import loose_title
from . import retrieval

#: Columns that are a person's judgement and never extracted, and the field that must stay critical.
EDITORIAL, CRITICAL = ("verdict", "status"), "metric_validated"


def empty_rates(corpus: retrieval.Corpus, probes: DataFrame, corpus_id: str = "default", top_k: int = 5) -> DataFrame:
    """term_logic, probes, empty: how many probes (query_id, text) find nothing. A measurement that never fails."""
    out = []
    for logic in ("all", "any"):
        found = retrieval.search(corpus, probes, top_k=top_k, corpus_id=corpus_id, term_logic=logic).select("query_id").distinct().withColumn("found", F.lit(True))
        out.append(probes.join(found, "query_id", "left").agg(F.lit(logic).alias("term_logic"), F.count("*").alias("probes"), F.count_if(F.col("found").isNull()).alias("empty")))
    return reduce(DataFrame.unionByName, out)


def unsupported_edges(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Resolved edges whose reference doesn't hold the target's title: edge_id, dst_paper_id.

    edges: edge_id, dst_paper_id, title, raw; papers: paper_id, title.  Case and
    punctuation don't count; from eight words the last two may be missing.
    """
    target = papers.select(F.col("paper_id").alias("dst_paper_id"), loose_title(F.col("title")).alias("_t")).where("_t <> ''")
    text = F.concat_ws(" ", loose_title(F.coalesce("title", F.lit(""))), loose_title(F.coalesce("raw", F.lit(""))))
    words = F.split("_t", " ")
    trimmed = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), " ")
    held = F.contains(text, F.col("_t")) | ((F.size(words) >= 8) & F.contains(text, trimmed))
    return edges.join(target, "dst_paper_id").where(~held).select("edge_id", "dst_paper_id")


def _row(name: str, rows: DataFrame, figure: Column, ok: Column) -> DataFrame:
    return rows.agg(F.lit(name).alias("criterion"), ok.alias("ok"), figure.cast("string").alias("figure"))


def exit_criteria(manifest: DataFrame, papers: DataFrame, tables: DataFrame, sections: DataFrame, paragraphs: DataFrame, edges: DataFrame, split: DataFrame, holdout: DataFrame, most_failures: float = 0.05) -> DataFrame:
    """criterion, ok, figure: what the ingest phase must have reached, a row each.

    manifest: external_id; papers: paper_id, external_id, status, reason;
    tables: paper_id, grid (header, rows); sections, paragraphs: paper_id;
    edges: dst_paper_id; split: paper_id, split; holdout: external_id.  Ten
    criteria: the split's size and its leak are told apart.
    """
    one = lambda rows, name: rows.agg(F.count("*").alias(name))  # noqa: E731  single rows, which cross joins put side by side
    total, bad = F.count("*"), F.count_if(F.col("status") != "ok")
    grid = F.col("grid")
    structured = F.count_if(F.coalesce((F.size(grid["rows"]) >= 1) & grid["header"].isNotNull(), F.lit(False)))
    stored = papers.crossJoin(one(manifest, "expected"))
    both = one(sections, "s").crossJoin(one(paragraphs, "p"))
    held = one(split.where("split = 'holdout'"), "held").crossJoin(one(holdout.select("external_id").distinct(), "named"))
    dev = split.where("split = 'dev'").join(papers.select("paper_id", "external_id"), "paper_id").join(holdout, "external_id", "left_semi")
    status = papers.groupBy("external_id").agg(F.max("status").alias("status"), F.max("reason").alias("reason"))
    listed = manifest.select("external_id").distinct().join(status, "external_id", "left")
    rows = [
        _row("all of the manifest is stored", listed, F.count_if(F.col("status").isNull()), F.count_if(F.col("status").isNull()) == 0),
        _row("no paper beside the manifest", stored, total, total == F.coalesce(F.max("expected"), F.lit(0))),
        _row("parse failures under the limit", papers, bad, F.coalesce(F.try_divide(bad, total), F.lit(1.0)) < most_failures),
        _row("every failure has a reason", papers, F.count_if((F.col("status") != "ok") & F.col("reason").isNull()), F.count_if((F.col("status") != "ok") & F.col("reason").isNull()) == 0),
        _row("tables are stored", tables, total, total > 0),
        _row("every table has a header and a row", tables, structured, structured == total),
        _row("sections and paragraphs are stored", both, F.max(F.col("s") + F.col("p")), F.max(F.least("s", "p")) > 0),
        _row("citation edges are stored", edges, total, total > 0),
        _row("the split holds out what the list names", held, F.max("held"), F.max(F.col("held") == F.col("named"))),
        _row("no listed paper is in development", dev, total, total == 0),
    ]
    return reduce(DataFrame.unionByName, rows)


def frozen_artifacts(holdout_text: DataFrame, holdout: DataFrame, manifest: DataFrame, schema: dict, gold: DataFrame | None = None) -> DataFrame:
    """artifact, problem, n: what is wrong with the frozen files; no rows if nothing is.

    holdout_text: value (the list's lines with its comments); holdout:
    external_id; manifest: external_id; schema: as ``guards.load_schema`` gives
    it; gold: external_id, or None while there is none.
    """
    spark = manifest.sparkSession

    def problem(artifact: str, text: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(artifact).alias("artifact"), F.lit(text).alias("problem"), "n")

    marks = holdout_text.agg(F.count_if(F.contains(F.upper("value"), F.lit("FROZEN"))).alias("marks")).where("marks = 0")
    fields = schema.get("fields") or []
    names = [f.get("name") for f in fields]
    faults = [("schema", f"{name} is a judgement, not a field", 1) for name in EDITORIAL if name in names]
    if not any(f.get("name") == CRITICAL and f.get("priority") == "critical" for f in fields):
        faults.append(("schema", f"{CRITICAL} isn't critical any more", 1))
    out = [
        problem("holdout", "the frozen mark is gone", marks),
        problem("holdout", "it names no paper", holdout.agg(F.count("*").alias("k")).where("k = 0")),
        problem("manifest", "an id occurs twice", manifest.groupBy("external_id").count().where("count > 1")),
        problem("manifest", "a held-out paper is missing", holdout.join(manifest, "external_id", "left_anti")),
        spark.createDataFrame(faults, "artifact string, problem string, n bigint"),
    ]
    if gold is not None:
        out.append(problem("gold", "a held-out paper is in it", gold.select("external_id").distinct().join(holdout, "external_id", "left_semi")))
    return reduce(DataFrame.unionByName, out)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same in every run: those with the least hashes of the key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def paper_sizes(papers: DataFrame) -> DataFrame:
    """external_id, n_sections, n_paragraphs, n_chars of nested papers."""
    texts = F.flatten(F.transform("sections", lambda s: F.transform(s["paragraphs"], lambda p: F.length(p["text"]))))
    total = F.aggregate(texts, F.lit(0).cast("bigint"), lambda a, n: a + F.coalesce(n, F.lit(0)))
    return papers.select("external_id", F.size("sections").alias("n_sections"), F.size(texts).alias("n_paragraphs"), total.alias("n_chars"))


def without_editorial(records: DataFrame, columns: tuple[str, ...] = EDITORIAL) -> DataFrame:
    """Extracted records (field, value) less what only people decide."""
    return records.where(~F.col("field").isin(*columns))
