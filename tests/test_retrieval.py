"""Search, retrievers, evaluation, audits, import and catalog on small inputs with known answers."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.config import ChunkConfig, RetrievalConfig, RunConfig
from lectern.operators import audits, dedupe, fusion, guards, layout, quality, retrieval
from lectern.sources import catalog


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


CONFIG = RunConfig(corpus_id="x", retrieval=RetrievalConfig(term_logic="any", top_k=2))


@pytest.fixture(scope="module")
def corpus(spark):
    print_ = CONFIG.chunk_fingerprint()
    papers = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "x")], "paper_id long, external_id string, corpus_id string")
    chunks = spark.createDataFrame(
        [(10, 1, "graph codes of a graph", print_), (11, 1, "codes for a long way to the graph", "other"), (20, 2, "trees only", print_), (30, 3, "graph codes", print_), (40, 4, "held graph codes", print_), (50, 9, "graph codes without a paper", print_)],
        "chunk_id long, paper_id long, text string, config_fingerprint string",
    )
    split = spark.createDataFrame([(1, "dev"), (2, "dev"), (3, "dev"), (4, "holdout")], "paper_id long, split string")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 5.0]), (40, [1.0, 1.0])], "chunk_id long, embedding array<double>")
    return retrieval.Corpus(papers, chunks, split, vectors)


def asked(spark, *texts):
    return spark.createDataFrame([(k, t, [1.0, 0.1]) for k, t in enumerate(texts)], "query_id long, text string, embedding array<double>")


def test_search_sees_its_corpus_configuration_and_split(spark, corpus):
    q = asked(spark, "Graph codes", "", "nowhere")
    ids = lambda **k: [r[1] for r in rows(retrieval.search(corpus, q, **k), "query_id", "chunk_id")]
    assert ids(corpus_id="x") == [10, 11] and ids(corpus_id="y") == [30] and ids(corpus_id="z") == []
    assert ids(corpus_id="x", config_fingerprint="other") == [11]
    assert ids(corpus_id="x", include_holdout=True) == [10, 11, 40]
    assert ids(corpus_id="x", top_k=1) == [10]
    with pytest.raises(ValueError):
        retrieval.search(corpus, q, term_logic="some")
    hit = retrieval.search(corpus, q, corpus_id="x").where("chunk_id = 10").first()
    assert (hit.paper_id, hit.text, hit.rank) == (1, "graph codes of a graph", 1)


def covers(words, terms):
    """The shortest runs with all terms, by trying all runs."""
    found = [(a, b) for a, b in itertools.combinations_with_replacement(range(len(words)), 2) if terms <= set(words[a : b + 1])]
    least = [(a, b) for a, b in found if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found)]
    return sum(0.1 / (1 + sum(w not in terms for w in words[a : b + 1])) for a, b in least)


def test_cover_density_against_all_runs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 25))) for _ in range(60)]
    frames = [(k, k, t, "f") for k, t in enumerate(texts)]
    own = retrieval.Corpus(
        spark.createDataFrame([(k, str(k), "x") for k in range(60)], "paper_id long, external_id string, corpus_id string"), spark.createDataFrame(frames, "chunk_id long, paper_id long, text string, config_fingerprint string"),
        spark.createDataFrame([(k, "dev") for k in range(60)], "paper_id long, split string"),
    )
    queries = ["a b", "c", "a c d", "b b a"]
    for logic in ("all", "any"):
        got = {(r.query_id, r.chunk_id): r.score for r in retrieval.search(own, asked(spark, *queries), top_k=100, corpus_id="x", term_logic=logic).collect()}
        expected = {}
        for k, q in enumerate(queries):
            for c, t in enumerate(texts):
                terms, words = set(q.split()), t.split()
                if (terms <= set(words)) if logic == "all" else terms & set(words):
                    expected[k, c] = covers(words, terms) if logic == "all" else 0.1 * sum(w in terms for w in words)
        assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_retriever_follows_the_configuration(spark, corpus):
    q = asked(spark, "graph codes trees")
    assert rows(retrieval.default_retriever(CONFIG, corpus)(q, 5), "chunk_id") == [(10,), (20,)]
    mode = lambda **k: RunConfig(corpus_id="x", retrieval=RetrievalConfig(**k))
    dense = retrieval.default_retriever(mode(mode="dense"), corpus)(q, 5)
    assert rows(dense, "rank", "chunk_id", "paper_id") == [(1, 10, 1), (2, 20, 2)]
    hybrid = retrieval.default_retriever(mode(mode="hybrid", term_logic="any", weights=(0.0, 1.0)), corpus)(q, 5)
    assert rows(hybrid, "rank", "chunk_id", "paper_id") == [(1, 10, 1), (2, 20, 2)]
    for bad in (mode(rerank=True), mode(mode="hybrid", weights=(1.0,))):
        with pytest.raises(ValueError):
            retrieval.default_retriever(bad, corpus)
    with pytest.raises(ValueError):
        retrieval.default_retriever(mode(mode="dense"), retrieval.Corpus(corpus.papers, corpus.chunks, corpus.split))


def test_fusion_keeps_the_best_copys_row(spark):
    a = spark.createDataFrame([(1, 7, 2, "late"), (1, 8, 1, "first")], "query_id long, chunk_id long, rank int, note string")
    b = spark.createDataFrame([(1, 7, 1, "best"), (1, 8, 1, "second")], "query_id long, chunk_id long, rank int, note string")
    got = fusion.reciprocal_rank_fusion([a, b], payload=("note",), weights=(1.0, 2.0))
    assert rows(got, "chunk_id", "note") == [(7, "best"), (8, "first")]
    assert {r.chunk_id: r.score for r in got.collect()}[7] == pytest.approx(1 / 62 + 2 / 61)


def test_run_eval(spark, corpus):
    questions = spark.createDataFrame([(0, "graph codes", "single_hop"), (1, "trees", "single_hop"), (2, "?", "unanswerable")], "query_id long, text string, type string")
    gold = spark.createDataFrame([(0, 1, 1.0, 0), (1, 1, 1.0, 0)], "query_id long, paper_id long, relevance double, pos int")
    report = retrieval.run_eval(corpus, questions, gold, CONFIG)
    assert {r.query_id: r.hit for r in report.per_question.collect()} == {0: 1.0, 1: 0.0}
    assert any("1 unanswerable" in w for w in report.warnings) and any("fewer than 60" in w for w in report.warnings) and any("term_logic" in w for w in report.warnings)
    assert report.lines()[1].startswith("overall: n 2, recall 0.500") and report.fingerprint == CONFIG.fingerprint()
    with pytest.raises(guards.HoldoutLeak):
        retrieval.run_eval(corpus, questions, gold, CONFIG, retriever=retrieval.default_retriever(CONFIG, corpus, include_holdout=True))
    final = RunConfig(corpus_id="x", phase=6, retrieval=CONFIG.retrieval)
    assert retrieval.run_eval(corpus, questions, gold, final, retriever=retrieval.default_retriever(CONFIG, corpus, include_holdout=True)).n_questions == 3


def test_abstention(spark):
    hits = spark.createDataFrame([(1, 0.5), (1, 0.1), (2, 0.1)], "query_id long, score double")
    assert rows(retrieval.abstain(hits, spark.range(1, 4).withColumnRenamed("id", "query_id"), 0.3)) == [(1, False), (2, True), (3, True)]


def test_frozen_artifacts(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "external_id string")
    text = lambda *x: spark.createDataFrame([(i,) for i in x], "value string")
    good = {"fields": [{"name": "metric_validated", "priority": "critical"}, {"name": "snr"}]}
    assert audits.frozen_artifacts(text("# FROZEN 2020", "a"), ids("a"), ids("a", "b"), good, ids("b")).count() == 0
    bad = {"fields": [{"name": "verdict"}, {"name": "metric_validated"}]}
    found = rows(audits.frozen_artifacts(text("a"), ids("a", "c"), ids("a", "b", "b"), bad, ids("a", "b")), "artifact", "n")
    assert found == [("gold", 1), ("holdout", 1), ("manifest", 1), ("manifest", 1), ("schema", 1), ("schema", 1)]
    assert rows(audits.frozen_artifacts(text("frozen"), ids(), ids("a"), good), "problem") == [("it names no paper",)]


def test_samples_sizes_and_judgements(spark):
    a = rows(audits.seeded_sample(spark.range(1000), "id", 10, seed=3))
    assert a == rows(audits.seeded_sample(spark.range(1000).repartition(7), "id", 10, seed=3)) and len(a) == 10 != rows(audits.seeded_sample(spark.range(1000), "id", 10, seed=4))
    papers = spark.sql("SELECT 'a' AS external_id, array(named_struct('paragraphs', array(named_struct('text', 'abc'), named_struct('text', null))), named_struct('paragraphs', array(named_struct('text', 'de')))) AS sections")
    assert rows(audits.paper_sizes(papers)) == [("a", 2, 3, 5)]
    records = spark.createDataFrame([("verdict", 1), ("snr", 2)], "field string, value int")
    assert rows(audits.without_editorial(records)) == [("snr", 2)]
    lines = spark.createDataFrame([(1, 1), (1, 4), (2, 2)], "doc_id long, page int")
    assert rows(layout.page_counts(lines)) == [(1, 4), (2, 2)]


def test_table_grids(spark):
    header, body = ["k", "v"], [["a", "1"], ["b", "2"], ["c", "3"]]
    boxes = [
        (1, 1, 0.0, 0.0, 10.0, 10.0, header, [header, *body]), (1, 2, 1.0, 1.0, 9.0, 9.0, header, body), (1, 3, 50.0, 50.0, 60.0, 60.0, header, [header, ["", ""], ["only", "row"], ["", None]]),
        (1, 4, 70.0, 70.0, 75.0, 75.0, None, [["x"], ["y"]]), (2, 5, 0.0, 0.0, 5.0, 5.0, None, body), (2, 6, 20.0, 20.0, 29.0, 29.0, header, [header, ["just", "one"], ["", ""]]),
    ]
    tables = spark.createDataFrame(boxes, "page_id long, box_id long, x0 double, y0 double, x1 double, y1 double, header array<string>, rows array<array<string>>")
    lines = spark.createDataFrame([(2, 1, 20.0, 15.0, 29.0, 16.0, "Table 3: Short"), (2, 2, 20.0, 17.0, 29.0, 18.0, "goes on here"), (2, 3, 20.0, 18.0, 29.0, 19.0, "Table 4: Other")], "page_id long, ordinal int, x0 double, y0 double, x1 double, y1 double, text string")
    captions = quality.captions_near(tables.where("box_id IN (3, 6)"), lines)
    assert rows(captions, "box_id", "label", "caption") == [(6, "Table 3", "Short goes on here")]
    got = {r.box_id: r for r in quality.table_grids(tables, captions).collect()}
    assert sorted(got) == [1, 5]
    assert got[1]["rows"] == body and (got[1].row_count, got[1].col_count, got[1].ordinal) == (3, 2, 0)
    worse = quality.more_than_baseline(spark.createDataFrame([([["1.0 2.0 3.0"]],), ([["x"]],)], "rows array<array<string>>"), 0).first()
    assert (worse.merged, worse.huge, worse.worse) == (1, 0, True)


def test_import_is_a_dry_run_until_it_is_applied(spark, tmp_path):
    plan = spark.createDataFrame([("n", "s1", "New", "add", None), ("m", "s2", "Old", "skip", "known id")], "external_id string, sha256 string, title string, action string, reason string")
    manifest = spark.createDataFrame([("a", "s0", "Alpha")], "external_id string, sha256 string, title string")
    told = spark.createDataFrame([], "external_id string, sha256 string, action string, reason string")
    after, reasons = dedupe.apply_import(plan, manifest, told)
    assert rows(after, "external_id") == [("a",), ("n",)] and reasons.count() == 2 and not list(tmp_path.iterdir())
    dedupe.apply_import(plan, manifest, told, folder=str(tmp_path / "new"))
    assert rows(spark.read.parquet(str(tmp_path / "new/manifest"))) == rows(after)


def test_catalog(spark, tmp_path, monkeypatch):
    name = f"db_{random.randrange(10**9)}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}'")
    assert "no table papers" in catalog.verify(spark, name)
    catalog.create(spark, name)
    catalog.create(spark, name)
    assert catalog.verify(spark, name) == [] and catalog.migrate(spark, name) == []
    spark.sql(f"INSERT INTO {name}.papers (paper_id) VALUES (1), (2), (3)")
    spark.sql(f"INSERT INTO {name}.corpus_split (paper_id, split) VALUES (1, 'dev'), (2, 'holdout')")
    assert [r.paper_id for r in spark.table(f"{name}.v_dev_papers").collect()] == [1]
    monkeypatch.setitem(catalog.TABLES, "papers", catalog.TABLES["papers"] + ", note string")
    assert catalog.verify(spark, name) == ["papers.note is missing"] and catalog.migrate(spark, name) == ["papers.note"]
    assert catalog.verify(spark, name) == [] and "note" in spark.table(f"{name}.v_dev_papers").columns
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_chunk_configurations_have_fingerprints_of_their_own():
    assert re.fullmatch("[0-9a-f]{16}", CONFIG.chunk_fingerprint())
    assert RunConfig(corpus_id="x", chunking=ChunkConfig(strategy="section")).chunk_fingerprint() != CONFIG.chunk_fingerprint()
