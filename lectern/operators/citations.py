"""Citation edges resolved by identity first, by title phrase last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import LONG_TITLE_TOKENS, arxiv_key, doi_key, find_arxiv, find_doi, phrase_udf, reference_phrase_udf, title_matches

_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
#: Words of an anchor.
RUNS = (1, 2, 4, 8)


def _keyed(papers: DataFrame, key: Column) -> DataFrame:
    """key, dst: the greatest id where several papers share a key."""
    return papers.select(key.alias("key"), "paper_id").where("key IS NOT NULL AND key <> ''").groupBy("key").agg(F.max("paper_id").alias("dst"))


def _longest(words: Column) -> Column:
    """The longest of some words, the first by text among equals; null without any."""
    return F.get(F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 0)


def contained_titles(references: DataFrame, titles: DataFrame) -> DataFrame:
    """(edge_id, paper_id) where a title's phrase is in a reference's.

    references: edge_id, h; titles: paper_id, t of four words or more.  A title
    meets a reference only through an anchor: the longest of the inner words
    that must be there.  The first and the last word of a phrase may be part of
    a longer word of the reference, inner ones may not.
    """
    words = F.split("t", " ")
    needed = F.when(F.size(words) >= LONG_TITLE_TOKENS, F.size(words) - 2).otherwise(F.size(words))
    anchored = titles.withColumn("word", _longest(F.slice(words, F.lit(2), F.greatest(needed - 2, F.lit(0)))))
    spread = references.select("edge_id", "h", F.explode(F.array_distinct(F.split("h", " "))).alias("word"))
    return spread.join(anchored, "word").where(title_matches(F.col("t"), F.col("h"))).select("edge_id", "paper_id")


def resolve(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """edges with dst_paper_id, how (doi, arxiv, title or null) and outcome (resolved, self, ambiguous, unresolved).

    edges: edge_id, src_paper_id, raw, title, doi, arxiv_id; papers: paper_id,
    title, doi, arxiv_id.  Links are computed anew, never carried over.
    """
    by = {"doi": _keyed(papers, doi_key(F.col("doi"))), "arxiv": _keyed(papers, arxiv_key(F.col("arxiv_id"))), "title": _keyed(papers, phrase_udf("title"))}
    out = edges.withColumn("_t", phrase_udf("title"))
    steps = [("doi", doi_key(F.col("doi"))), ("arxiv", arxiv_key(F.col("arxiv_id"))), ("title", F.col("_t")), ("doi", doi_key(find_doi(F.col("raw")))), ("arxiv", find_arxiv(F.col("raw")))]
    for k, (name, key) in enumerate(steps):
        out = out.withColumn(f"_k{k}", key).join(by[name].select(F.col("key").alias(f"_k{k}"), F.col("dst").alias(f"_d{k}")), f"_k{k}", "left")
    found = F.coalesce(*[F.col(f"_d{k}") for k in range(len(steps))])
    how = F.coalesce(*[F.when(F.col(f"_d{k}").isNotNull(), F.lit(name)) for k, (name, _) in enumerate(steps)])
    out = out.select(*edges.columns, found.alias("_found"), how.alias("_how"))
    rest = out.where("_found IS NULL").select("edge_id", reference_phrase_udf(F.coalesce(F.nullif("title", F.lit("")), "raw")).alias("h")).where("h IS NOT NULL")
    titles = papers.where("title IS NOT NULL").select("paper_id", phrase_udf("title").alias("t")).where("size(split(t, ' ')) >= 4")
    phrases = contained_titles(rest, titles).groupBy("edge_id").agg(F.count("*").alias("_n"), F.max("paper_id").alias("_one"))
    out = out.join(phrases, "edge_id", "left")
    dst = F.coalesce("_found", F.when(F.col("_n") == 1, F.col("_one")))
    own = dst == F.col("src_paper_id")
    outcome = F.when(dst.isNull(), F.when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")).when(own, "self").otherwise("resolved")
    kept = F.when(~F.coalesce(own, F.lit(False)), dst)
    return out.select(*edges.columns, kept.alias("dst_paper_id"), F.when(kept.isNotNull(), F.coalesce("_how", F.lit("title"))).alias("how"), outcome.alias("outcome"))


def resolution_counts(resolved: DataFrame) -> DataFrame:
    """One row of counters; self and ambiguous edges count as unresolved too."""
    by = lambda name: F.count_if(F.col("how") == name).alias(f"by_{name}")
    return resolved.agg(
        F.count("*").alias("total"), by("doi"), by("arxiv"), by("title"), F.count_if(F.col("dst_paper_id").isNull()).alias("unresolved"), F.count_if(F.col("outcome") == "self").alias("self_citations"), F.count_if(F.col("outcome") == "ambiguous").alias("ambiguous")
    )


def _runs(words: Column, length: int, make) -> Column:
    """``make(hash, start)`` for each run of as many words as ``length``; each word is read in place, so the work is linear."""
    run = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(length)])
    return F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda i: make(run(i), i))


def _longest_run(words: Column, length: int) -> Column:
    """Hash of the run with most characters, the first among equals."""
    size = lambda i: sum((F.length(F.get(words, i + j)) for j in range(1, length)), F.length(F.get(words, i)))
    return F.array_max(_runs(words, length, lambda run, i: F.struct(size(i).alias("n"), (-i).alias("i"), run.alias("run"))))["run"]


def containment(documents: DataFrame, phrases: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """(item_id, doc_id) where a document contains a phrase verbatim, for each row of either.

    phrases: item_id, text, sent to the tasks in blocks of ``max_bytes``.  A
    phrase meets a document through an anchor, a run of eight (or four, two,
    one where there are fewer) of its inner words between white space, which
    the document must have as words; then the texts are compared, in place: no
    document is moved.  Phrases of one or two words have no such anchor and are
    compared with each document.
    """
    items = phrases.where("text IS NOT NULL").select("item_id", F.col("text").alias("needle"))
    parts = F.split("needle", _SPACE)
    items = items.withColumn("inner", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
    length, run = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for k in sorted(RUNS):
        length, run = (F.when(F.size("inner") >= k, x).otherwise(y) for x, y in ((F.lit(k), length), (_longest_run(F.col("inner"), k), run)))
    items = items.select("item_id", "needle", length.alias("length"), run.alias("run"))
    docs = documents.select("doc_id", "text")
    blocks = lambda size: 1 + 2 * size // max_bytes
    size = lambda anchored: F.sum(F.when(F.col("run").isNotNull() == anchored, F.octet_length("needle")))
    lengths, total, rest = items.agg(F.collect_set("length"), size(True), size(False)).first()
    own = lambda rows, n, k: F.broadcast(rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k))
    met = docs.join(items, F.lit(False)).select("item_id", "doc_id")
    found = []
    if lengths:
        anchors = items.where("run IS NOT NULL").select("item_id", "needle", "run")
        words = docs.select("*", F.explode(F.array(F.split("text", _SPACE))).alias("w"))  # words stay a column, split once
        runs = [F.when(F.size("w") >= k, _runs(F.col("w"), k, lambda run, i: run)).otherwise(F.array().cast("array<bigint>")) for k in sorted(lengths)]
        spread = words.select("doc_id", "text", F.array_distinct(F.concat(*runs)).alias("runs")).select("doc_id", "text", F.explode_outer("runs").alias("run"))
        found += [spread.join(own(anchors, n, k), "run").where(F.contains("text", "needle")) for n in [blocks(total)] for k in range(n)]
    if rest is not None:
        short = items.where("run IS NULL").select("item_id", "needle")
        found += [docs.join(own(short, n, k), F.contains(F.col("text"), F.col("needle"))) for n in [blocks(rest)] for k in range(n)]
    return reduce(DataFrame.unionByName, [rows.select("item_id", "doc_id") for rows in found], met) if len(found) != 1 else found[0].select("item_id", "doc_id")
