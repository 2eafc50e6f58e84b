"""Lexical search over an inverted index, all queries in one plan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.stem import stems_udf
from ..functions.text import terms

#: One chunk in so many is counted first, for a bound that all chunks are then held to.
SOME = 32


def _terms(text: Column, stemmed: bool) -> Column:
    return stems_udf(terms(text)) if stemmed else terms(text)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by chunk, to a number of parts, since parts joined to a size would hold many times that in pairs with queries."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", stemmed: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """chunk, term, tf: the index. Stored once for a configuration, it serves any number of queries.

    stemmed: English stems without stop words; the queries must be made alike.
    wanted: the terms (term) that will be asked for, if they are known already;
    all others are left out before anything is grouped, and what is left is
    dealt by chunk.
    """
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(_terms(F.col(text_col), stemmed)).alias("term"))
    if wanted is not None:
        rows = _dealt(rows.join(wanted.select("term").distinct(), "term", "left_semi"))
    return rows.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text", stemmed: bool = False) -> DataFrame:
    """query, term, n_terms: the distinct terms; a query without terms has no rows, and so no hits."""
    own = F.array_distinct(_terms(F.col(text_col), stemmed))
    return queries.select(F.col(id_col).alias("query_id"), own.alias("t")).select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term"))


def _floors(queries: DataFrame, index: DataFrame, top_k: int) -> DataFrame:
    """query_id, floor: the ``top_k`` best chunks of these postings match so many terms at least; no row where there are fewer chunks."""
    found = index.join(F.broadcast(queries), "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("matched"))
    counts = found.groupBy("query_id", "matched").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.collect_list(F.struct("matched", "n")).alias("c"))
    above = lambda m: F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["matched"] >= m, x["n"]).otherwise(0))
    enough = F.filter("c", lambda x: above(x["matched"]) >= top_k)
    return counts.select("query_id", F.array_max(F.transform(enough, lambda x: x["matched"])).alias("floor")).where("floor IS NOT NULL")


def _needs(queries: DataFrame, some: DataFrame, top_k: int, term_logic: str) -> DataFrame:
    """query_id, own (its terms, those rare in ``some`` postings first), few (a hit has so many of them at least), marks (their hashes), like (of which it has so many)."""
    seen = some.groupBy("term").agg(F.count("*").alias("seen"))
    rows = queries.join(F.broadcast(seen), "term", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    rows = rows.groupBy("query_id").agg(F.first("n_terms").alias("n"), F.count("*").alias("every"), F.array_sort(F.collect_set(F.struct("seen", "term")))["term"].alias("own"))
    least = F.col("n")
    if term_logic == "any":
        floors = _floors(queries, some, top_k).withColumnRenamed("query_id", "_query")
        rows, least = rows.join(F.broadcast(floors), F.col("query_id").eqNullSafe(F.col("_query")), "left"), F.coalesce("floor", F.lit(1))
    counted = F.col("every") - F.size("own") + 1  # a term counts so often at most, where a query's id is repeated
    rows = rows.select("query_id", "own", F.greatest(F.ceil(least / counted), F.lit(1)).alias("few"), F.array_distinct(F.transform("own", lambda t: F.xxhash64(t))).alias("marks"))
    return rows.withColumn("like", F.col("few") - (F.size("own") - F.size("marks")))


def _found(queries: DataFrame, index: DataFrame, top_k: int, term_logic: str) -> DataFrame:
    """query_id, chunk_id, matched, tf, n_terms of all pairs that may be hits.

    Any ``top_k`` chunks that match a query bound its hits from below: what
    matches fewer terms than the least of them is none.  So some chunks, by
    their hash, are counted first.  A chunk with ``few`` of a query's terms has
    one at least of all but ``few - 1`` of them: only the rarest ones make pairs,
    and a pair is dropped where it arises unless its terms are enough, by their
    hashes first.
    """
    needs = _needs(queries, index.where(F.pmod(F.xxhash64("chunk_id"), F.lit(SOME)) == 0), top_k, term_logic)
    keys = needs.select(F.col("query_id").alias("_query"), "few", F.explode(F.slice("own", F.lit(1), F.greatest(F.size("own") - F.col("few") + 1, F.lit(0)).cast("int"))).alias("key"))
    chunks = index.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("posts"), F.collect_list(F.xxhash64("term")).alias("hashes")).withColumn("held", F.col("posts")["term"])
    met = chunks.select("*", F.explode("held").alias("key")).join(F.broadcast(keys), "key").where(F.size("held") >= F.col("few"))
    met = met.drop("few").join(F.broadcast(needs), F.col("_query").eqNullSafe(F.col("query_id"))).drop("query_id")
    common = F.array_intersect("own", "held")
    met = met.where((F.size(F.array_intersect("marks", "hashes")) >= F.col("like")) & (F.size(common) >= F.col("few")) & (F.get(common, F.lit(0)) == F.col("key")))  # once, by the first of them
    terms_met = met.select("_query", "chunk_id", F.inline("posts")).withColumnRenamed("term", "_term")
    found = terms_met.join(F.broadcast(queries), F.col("_query").eqNullSafe(F.col("query_id")) & (F.col("_term") == F.col("term")))
    return found.groupBy("query_id", "chunk_id").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf"), F.first("n_terms").alias("n_terms"))


def search(queries: DataFrame, index: DataFrame, *, top_k: int = 5, term_logic: str = "all", dealt: bool = False, max_terms: int = 1 << 20) -> DataFrame:
    """Hits (query_id, chunk_id, score, rank) with contiguous ranks from 1.

    Members: chunks with all of a query's terms, or with any. Score: the number
    of distinct query terms in the chunk, then their occurrences (term
    frequency, not cover density); ties go to the lesser chunk id.
    queries: ``query_terms``, sent to the tasks in blocks of about
    ``max_terms`` rows; index: ``postings``.

    Where a chunk's postings lie in one part, its pairs with the queries are
    made, added up and ranked where they arise, and only each part's best ones
    move on.  dealt: they do, as ``postings`` with ``wanted`` leaves them;
    others are dealt first.
    """
    if term_logic not in ("all", "any"):
        raise ValueError(f"term_logic is 'all' or 'any', not {term_logic!r}")
    if not dealt:
        index = _dealt(index.join(queries.select("term").distinct(), "term", "left_semi"))
    blocks = 1 + queries.count() // max_terms
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [_found(queries.where(block == k) if blocks > 1 else queries, index, top_k, term_logic) for k in range(blocks)])
    if term_logic == "all":
        found = found.where("matched = n_terms")
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("tf"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "chunk_id", "matched", "tf", "rank")


def phrase_search(queries: DataFrame, chunks: DataFrame, *, top_k: int = 5) -> DataFrame:
    """Chunks that hold a query's terms in sequence; anchored on the query's longest term, then verified."""
    words = queries.select("query_id", terms(F.col("text")).alias("q")).where("size(q) > 0")
    anchored = words.withColumn("term", F.array_sort("q", lambda a, b: F.length(b) - F.length(a))[0])
    tokens = chunks.select("chunk_id", terms(F.col("text")).alias("t"))
    near = tokens.select("chunk_id", "t", F.explode(F.array_distinct("t")).alias("term")).join(anchored, "term")
    line = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    found = near.where(F.contains(line("t"), line("q")))
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    return found.select("query_id", "chunk_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top_k)


def parse_web_query(text: str) -> tuple[list[list[str]], list[str], list[str]]:
    """A web-search string as (groups, phrases, excluded): a chunk must have one term of each group.

    ``or`` joins the terms beside it to a group, quotes make a phrase (whose
    terms are groups too), a leading hyphen excludes a term.
    """
    groups: list[list[str]] = []
    phrases: list[str] = []
    excluded: list[str] = []
    join = False
    for match in re.finditer(r'(-?)"([^"]*)"|(\S+)', text.lower()):
        word = match[3] or ""
        if word == "or" and groups:
            join = True
            continue
        found = re.findall("[a-z0-9]+", match[2] if match[3] is None else word)
        if not found:
            continue
        if match[1] or word.startswith("-"):
            excluded += found
        elif match[3] is None:
            phrases.append(" ".join(found))
            groups += [[w] for w in found]
        elif join:
            groups[-1] += found
        else:
            groups += [[w] for w in found]
        join = False
    return groups, phrases, excluded


def web_search(spark: SparkSession, queries: dict[int, str], chunks: DataFrame, *, top_k: int = 5) -> DataFrame:
    """Hits (query_id, chunk_id, matched, rank) of web-search strings, which are the caller's own and few."""
    parsed = {k: parse_web_query(v) for k, v in queries.items()}
    wanted = spark.createDataFrame([(k, i, w) for k, (g, _, _) in parsed.items() for i, group in enumerate(g) for w in group], "query_id bigint, grp int, term string")
    needs = spark.createDataFrame([(k, len(g), p) for k, (g, p, _) in parsed.items()], "query_id bigint, n int, phrases array<string>")
    banned = spark.createDataFrame([(k, w) for k, (_, _, e) in parsed.items() for w in e], "query_id bigint, term string")
    index = postings(chunks)
    found = index.join(F.broadcast(wanted), "term").groupBy("query_id", "chunk_id").agg(F.count_distinct("grp").alias("matched"), F.sum("tf").alias("tf"))
    found = found.join(F.broadcast(needs), "query_id").where("matched = n")
    found = found.join(index.join(F.broadcast(banned), "term").select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    line = F.concat(F.lit(" "), F.array_join(terms(F.col("text")), " "), F.lit(" "))
    found = found.join(chunks.select("chunk_id", line.alias("line")), "chunk_id").where(F.forall("phrases", lambda p: F.contains(F.col("line"), F.concat(F.lit(" "), p, F.lit(" ")))))
    order = Window.partitionBy("query_id").orderBy(F.desc("tf"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "chunk_id", "matched", "rank")
