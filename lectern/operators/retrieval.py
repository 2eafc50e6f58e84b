"""Retrieval bound to a corpus, a chunk configuration and a split, and its evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from ..config import RunConfig
from ..functions.text import terms
from . import dense, evaluation, fusion, guards, splits

#: What a cover of text without weights counts for.
COVER = 0.1


@dataclass(frozen=True)
class Corpus:
    """papers: paper_id, external_id, corpus_id; chunks: chunk_id, paper_id, text, config_fingerprint;
    split: paper_id, split; vectors (for dense retrieval): chunk_id, embedding."""

    papers: DataFrame
    chunks: DataFrame
    split: DataFrame
    vectors: DataFrame | None = None


def visible_chunks(corpus: Corpus, corpus_id: str, config_fingerprint: str | None = None, include_holdout: bool = False) -> DataFrame:
    """The chunks of a corpus, of one configuration if it is given, without held-out papers unless asked for."""
    chunks = corpus.chunks if config_fingerprint is None else corpus.chunks.where(F.col("config_fingerprint") == config_fingerprint)
    own = corpus.papers.where(F.col("corpus_id") == corpus_id).select("paper_id")
    chunks = chunks.join(own, "paper_id", "left_semi")
    return chunks if include_holdout else splits.dev_only(chunks, corpus.split)


def _cover_score(logic: str):
    """The sum of COVER / (1 + other words in it) over the covers of (hits, n_terms).

    hits: (pos, t) in order of pos, t from 0.  For ``any`` each hit is a cover;
    for ``all`` covers are the shortest runs of words with all terms.
    """
    if logic == "any":
        return F.size("hits") * F.lit(COVER)
    start = F.struct(F.transform(F.sequence(F.lit(1), F.col("n_terms")), lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("score"))

    def step(state, i):
        hit = F.get("hits", i)
        last = F.transform(state["last"], lambda x, t: F.when(t == hit["t"], i).otherwise(x))
        begin = F.array_min(last)
        other = (hit["pos"] - F.get("hits", begin)["pos"]) - (i - begin)
        gain = F.when(begin > state["begin"], F.lit(COVER) / (1 + other)).otherwise(0.0)
        return F.struct(last.alias("last"), F.greatest(begin, state["begin"]).alias("begin"), (state["score"] + gain).alias("score"))

    return F.aggregate(F.sequence(F.lit(0), F.size("hits") - 1), start, step, lambda s: s["score"])


def search(
    corpus: Corpus, queries: DataFrame, *, top_k: int = 5, corpus_id: str = "default", config_fingerprint: str | None = None, term_logic: str = "all", include_holdout: bool = False
) -> DataFrame:
    """Hits (query_id, chunk_id, paper_id, text, score, rank) of queries (query_id, text), all in one plan.

    Members are chunks with all of a query's terms, or with any; the score is
    their cover density, ties go to the lesser chunk id.  Only the questions'
    terms are looked up, and texts are fetched for the ranked chunks alone.
    """
    if term_logic not in ("all", "any"):
        raise ValueError(f"term_logic is 'all' or 'any', not {term_logic!r}")
    chunks = visible_chunks(corpus, corpus_id, config_fingerprint, include_holdout)
    asked = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("q")).select("query_id", F.size("q").alias("n_terms"), F.posexplode("q").alias("t", "term"))
    pairs = ["query_id", "chunk_id"]
    if term_logic == "all":  # positions are looked at only where all terms are there
        own = chunks.select("chunk_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(asked.select("query_id", "n_terms", "term"), "term")
        full = own.groupBy(*pairs, "n_terms").agg(F.count("*").alias("matched")).where("matched = n_terms").select(*pairs)
        words = chunks.join(full.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
        hits = words.join(asked, "term").join(full, pairs, "left_semi")
    else:
        hits = chunks.select("chunk_id", F.posexplode(terms(F.col("text"))).alias("pos", "term")).join(asked, "term")
    found = hits.groupBy(*pairs, "n_terms").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("hits"))
    scored = found.select("query_id", "chunk_id", F.round(_cover_score(term_logic), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.join(chunks.select("chunk_id", "paper_id", "text"), "chunk_id").select("query_id", "chunk_id", "paper_id", "text", "score", "rank")


def default_retriever(config: RunConfig, corpus: Corpus, include_holdout: bool = False) -> Callable[[DataFrame, int], DataFrame]:
    """The configuration's retriever: queries (query_id, text, for dense ones embedding) and k -> query_id, chunk_id, paper_id, rank.

    Chunks are those of the configuration's fingerprint; the mode picks lexical
    or dense search or both, fused by rank with the configured weights.  There
    is no reranker: a configuration that asks for one raises.
    """
    if config.retrieval.rerank:
        raise ValueError("there is no reranker")
    mode = config.retrieval.mode
    if mode != "fts" and corpus.vectors is None:
        raise ValueError(f"mode {mode!r} needs vectors")
    weights = config.retrieval.weights or (1.0, 1.0)
    if mode == "hybrid" and len(weights) != 2:
        raise ValueError("hybrid retrieval takes two weights")

    def lexical(queries: DataFrame, top_k: int) -> DataFrame:
        return search(
            corpus, queries, top_k=top_k, corpus_id=config.corpus_id, config_fingerprint=config.chunk_fingerprint(), term_logic=config.retrieval.term_logic, include_holdout=include_holdout
        ).select("query_id", "chunk_id", "paper_id", "rank")

    def nearest(queries: DataFrame, top_k: int) -> DataFrame:
        owners = visible_chunks(corpus, config.corpus_id, config.chunk_fingerprint(), include_holdout).select("chunk_id", "paper_id")
        made = dense.unit if config.embedding.normalize else lambda v: v
        vectors = corpus.vectors.join(owners, "chunk_id").select(F.col("chunk_id").alias("vec_id"), made(F.col("embedding")).alias("embedding"))
        hits = dense.nearest(queries.select("query_id", made(F.col("embedding")).alias("embedding")), vectors, top_k=top_k)
        return hits.withColumnRenamed("vec_id", "chunk_id").join(owners, "chunk_id").select("query_id", "chunk_id", "paper_id", "rank")

    def both(queries: DataFrame, top_k: int) -> DataFrame:
        rankings = [lexical(queries, top_k), nearest(queries, top_k)]
        return fusion.reciprocal_rank_fusion(rankings, k=config.retrieval.rrf_k, top_k=top_k, weights=weights, payload=("paper_id",)).select("query_id", "chunk_id", "paper_id", "rank")

    return {"fts": lexical, "dense": nearest, "hybrid": both}[mode]


@dataclass
class EvalReport:
    """Scores of a run: a row for each question, the summary's rows, and what to know about them."""

    fingerprint: str
    n_questions: int
    top_k: int
    per_question: DataFrame
    summary: DataFrame
    warnings: list[str] = field(default_factory=list)

    def lines(self) -> list[str]:
        """For people: one line for each scope, then the warnings."""
        number = lambda x: "-" if x is None else f"{x:.3f}"
        rows = sorted(self.summary.collect(), key=lambda r: (r.scope != "overall", r.scope))
        head = f"configuration {self.fingerprint}, {self.n_questions} questions, top {self.top_k}"
        return [head, *(f"{r.scope}: n {r.n}, recall {number(r.recall)}, precision {number(r.precision)}, hit {number(r.hit)}, mrr {number(r.rr)}, ndcg {number(r.ndcg)}" for r in rows), *(f"warning: {w}" for w in self.warnings)]


def run_eval(corpus: Corpus, questions: DataFrame, gold: DataFrame, config: RunConfig, *, retriever: Callable[[DataFrame, int], DataFrame] | None = None) -> EvalReport:
    """Score a configuration at paper level.

    questions: query_id, text, type; gold: query_id, paper_id, relevance, pos.
    More chunks than papers are fetched, since a paper has several.  Before the
    final phase a held-out paper among the results raises ``HoldoutLeak``.
    """
    retrieve, top_k = retriever or default_retriever(config, corpus), config.retrieval.top_k
    asked = questions.where("type <> 'unanswerable'")
    hits = retrieve(asked, top_k * evaluation.OVER_FETCH)
    best = hits.groupBy("query_id", "paper_id").agg(F.min("rank").alias("best"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "paper_id"))).where(F.col("rank") <= top_k)
    guards.assert_no_holdout(ranked.select(F.col("paper_id").alias("id")), corpus.split.where("split = 'holdout'").select(F.col("paper_id").alias("id")), config.phase)
    scored = evaluation.per_question(questions, ranked, evaluation.gold_gains(gold), top_k)
    n, n_asked = questions.count(), asked.count()
    warnings = [r.warning for r in evaluation.size_warning(questions).collect() if r.warning]
    if n_asked < n:
        warnings.append(f"{n - n_asked} unanswerable questions are not scored: they measure abstention")
    warnings += [f"not justified: {name}" for name in config.unjustified()]
    return EvalReport(config.fingerprint(), n, top_k, scored, evaluation.summary(scored), warnings)


def abstain(hits: DataFrame, queries: DataFrame, least_score: float, least_hits: int = 1) -> DataFrame:
    """query_id, abstained: too few hits reach the score."""
    strong = hits.where(F.col("score") >= least_score).groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(strong, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) < least_hits).alias("abstained"))
