from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from lectern.config import ChunkConfig, RetrievalConfig, RunConfig
from lectern.functions import text as X
from lectern.operators import chunking, citations, comparison, dedupe, dense, evaluation, fusion, guards, layout, lexical, metrics, quality, splits, state
from lectern.sources import files, markup


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# chunking

TEXT = st.lists(st.text("ab. ([X", max_size=40), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(4, 30))
def test_packed_text_is_where_the_spans_say(texts, budget):
    given_ = [(k, t) for k, t in enumerate(texts) if t.strip()]
    source = dict(given_)
    for text, spans in chunking.pack(given_, budget):
        assert text == " ".join(source[p][b:e] for p, b, e in spans)
        assert sum(e - b for _, b, e in spans) <= budget or len(spans) == 1
    seen = [s for _, spans in chunking.pack(given_, budget) for s in spans]
    assert seen == sorted(seen)
    assert sum(len(re.sub(r"\s", "", source[p][b:e])) for p, b, e in seen) == sum(len(re.sub(r"\s", "", t)) for t in source.values())


def test_long_paragraph_starts_a_chunk_and_stays_open():
    made = chunking.pack([(1, "short"), (2, "One one one. Two two two."), (3, "tail")], 14)
    assert [spans for _, spans in made] == [[(1, 0, 5)], [(2, 0, 12)], [(2, 13, 25)], [(3, 0, 4)]]
    assert chunking.pack([(1, "x" * 25)], 10) == [("x" * 10, [(1, 0, 10)]), ("x" * 10, [(1, 10, 20)]), ("x" * 5, [(1, 20, 25)])]


def test_overlap_carries_no_spans():
    made = chunking.pack([(1, "abcdefgh"), (2, "ijklmnop")], 8, overlap=3)
    assert made == [("abcdefgh", [(1, 0, 8)]), ("fgh ijklmnop", [(2, 0, 8)])]


def test_sections_are_not_crossed(spark):
    data = [(7, s, 10 * s + k, k, f"w{s}{k} " * 5) for s in (1, 2) for k in range(3)]
    par = spark.createDataFrame(data, "paper_id long, section_id long, paragraph_id long, ordinal int, text string")
    made = chunking.section_chunks(par, 512).orderBy("ordinal").collect()
    assert [(c.section_id, c.ordinal, len(c.spans)) for c in made] == [(1, 0, 3), (2, 1, 3)]
    flat = chunking.flat_chunks(par, 512).collect()
    assert len(flat) == 1 and flat[0].section_id is None and len(flat[0].spans) == 6
    assert chunking.flat_chunks(par.where("false"), 512).count() == 0
    with pytest.raises(ValueError):
        chunking.build_chunks(par, "nope", "f")


# text

def test_sentences_keep_decimals(spark):
    got = one(spark, X.sentences(F.lit("It rose to 0.75 in all. Then it fell! (See there.) x. y")))
    assert got == ["It rose to 0.75 in all.", "Then it fell!", "(See there.) x. y"]


def test_identifiers(spark):
    raw = F.lit("A, B. 10.1000/xyz-1. arXiv: 2108.09119v3 1999, 2025 and 2099")
    assert one(spark, X.find_doi(raw)) == "10.1000/xyz-1"
    assert one(spark, X.find_arxiv(raw)) == "2108.09119"
    assert one(spark, X.latest_year(raw)) == 2025
    assert one(spark, X.latest_year(F.lit("in 2099"))) is None
    assert one(spark, X.arxiv_key(F.lit("arXiv:2108.09119v3[cs.CL]"))) == "2108.09119"
    assert one(spark, X.doi_key(F.lit(" 10.1/A. "))) == "10.1/a"


def test_cleaning(spark):
    assert one(spark, X.clean_cell(F.lit(" a\x00  b "))) == "a b"
    assert one(spark, X.clean_cell(F.lit(None).cast("string"))) == ""
    assert one(spark, X.dehyphenate(F.lit("Commu- nication  é- tude"))) == "Communication étude"
    assert one(spark, X.dehyphenate(F.lit("x"))) is None
    assert one(spark, X.nul_free(F.lit("\x00"))) is None
    assert one(spark, X.slug(F.lit("12. A Title: of Things!"))) == "a-title-of-things"
    assert one(spark, X.section_kind(F.lit("VI. REFERENCES"))) == "references"
    assert one(spark, X.section_kind(F.lit("introduction"))) == "body"
    assert one(spark, X.section_kind(F.lit(""))) is None


@pytest.mark.parametrize("title, reference, expected", [
    ("Robust Semantic Coding by Graphs", 'A. B., "Robust semantic coding by graphs," 2020', True),
    ("Robust Semantic Coding by Graphs", "A. B., Robust semantic coding by graphs and trees, 2020", False),
    ("Deep Learning", "Deep learning.", False),
    ("A very long title with many words in it", "see a very long title with many words, 2020", True),
    ("Learning Enabled Systems for Communication", "x. Learning-enabled systems for commu- nication. y", True),
    ("Étude sur les réseaux sémantiques", "etude sur les reseaux semantiques", True),
])
def test_titles_in_references(spark, title, reference, expected):
    row = spark.createDataFrame([(title, reference)], "t string, r string").select(X.phrase_udf("t").alias("t"), X.reference_phrase_udf("r").alias("r"))
    assert row.select(X.title_matches(F.col("t"), F.col("r")).alias("x")).first().x is expected


# retrieval and metrics

def test_search_logic(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, "gamma"), (4, "")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "Alpha beta"), (2, "zzz"), (3, "...")], "query_id long, text string")
    index, terms = lexical.postings(chunks), lexical.query_terms(queries)
    assert rows(lexical.search(terms, index, term_logic="all"), "query_id", "chunk_id", "rank") == [(1, 1, 1)]
    assert rows(lexical.search(terms, index, term_logic="any"), "query_id", "chunk_id", "rank") == [(1, 1, 1), (1, 2, 2)]
    assert rows(lexical.phrase_search(queries, chunks), "query_id", "chunk_id") == [(1, 1)]
    with pytest.raises(ValueError):
        lexical.search(terms, index, term_logic="some")


def test_stems():
    from lectern.functions.stem import stem

    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing failing filing happy sky relational conditional rationalization vietnamization predication operator feudalism decisiveness hopefulness callousness formality triplicate formative electrical goodness revival allowance inference adjustable replacement adoption activate effective probate rate cease controlling generalizations by"
    stems = "caress poni ti cat feed agre plaster motor sing conflat troubl size hop fall hiss fail file happi sky relat condit ration vietnam predic oper feudal decis hope callous formal triplic form electr good reviv allow infer adjust replac adopt activ effect probat rate ceas control gener by"
    assert [stem(w) for w in words.split()] == stems.split()


def test_stemmed_search(spark):
    chunks = spark.createDataFrame([(1, "The relational operators are adopted"), (2, "nothing here")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "adoption of an operator"), (2, "the")], "query_id long, text string")
    got = lexical.search(lexical.query_terms(queries, stemmed=True), lexical.postings(chunks, stemmed=True))
    assert rows(got, "query_id", "chunk_id") == [(1, 1)]


def test_web_search(spark):
    assert lexical.parse_web_query('a "b c" or d -e -"f g" OR') == ([["a"], ["b"], ["c", "d"]], ["b c"], ["e", "f", "g"])
    chunks = spark.createDataFrame([(1, "red car, fast"), (2, "fast red truck"), (3, "car red"), (4, "")], "chunk_id long, text string")
    queries = {1: "red car", 2: '"red car"', 3: "car or truck -fast", 4: "zzz", 5: "car OR truck"}
    assert rows(lexical.web_search(spark, queries, chunks), "query_id", "chunk_id") == [(1, 1), (1, 3), (2, 1), (3, 3), (5, 1), (5, 2), (5, 3)]


def test_fusion(spark):
    lists = [spark.createDataFrame([(1, c, k + 1) for k, c in enumerate(x)], "query_id long, chunk_id long, rank int") for x in ([1, 2], [3, 2])]
    got = fusion.reciprocal_rank_fusion(lists, top_k=3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 3]
    assert got[0].score == pytest.approx(2 / 62) and got[1].score == pytest.approx(1 / 61)


def test_metrics(spark):
    found, relevant, none = F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "bdx")), F.array().cast("array<string>")
    assert one(spark, metrics.recall(found, relevant, 2)) == pytest.approx(1 / 3)
    assert one(spark, metrics.recall(found, none, 2)) == 0 and one(spark, metrics.recall(found, relevant, 0)) == 0
    assert one(spark, metrics.precision(found, relevant, 10)) == pytest.approx(0.5)
    assert one(spark, metrics.precision(none, relevant, 5)) == 0
    assert one(spark, metrics.hit(found, relevant, 1)) == 0 and one(spark, metrics.hit(found, relevant, 2)) == 1
    assert one(spark, metrics.reciprocal_rank(found, relevant)) == pytest.approx(0.5)
    assert one(spark, metrics.dcg(F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0)))) == pytest.approx(4.7619, abs=1e-4)
    gains = F.create_map(F.lit("a"), F.lit(3.0), F.lit("z"), F.lit(2.0))
    assert one(spark, metrics.ndcg(found, gains, 4)) == pytest.approx(3 / (3 + 2 / 1.5849625007211562))


def test_answer_metrics(spark):
    judged = spark.createDataFrame([(True, True, False), (False, True, True), (None, False, True), (None, False, False)], "entailed boolean, answerable boolean, abstained boolean")
    assert metrics.answer_metrics(judged).first() == (0.5, 0.5, 0.5)
    assert metrics.answer_metrics(judged.where("false")).first() == (0.0, 0.0, 0.0)


def test_last_relevance_holds(spark):
    gold = spark.createDataFrame([(1, 5, 1.0, 0), (1, 5, 0.5, 1)], "query_id long, paper_id long, relevance double, pos int")
    assert evaluation.gold_gains(gold).first().gains == {5: 0.5}


def test_dense_blocks(spark):
    vectors = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(6)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    assert rows(dense.nearest(queries, vectors, top_k=2)) == rows(dense.nearest(queries, vectors, top_k=2, batch=1))
    assert one(spark, dense.l2(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(*map(F.lit, (1.0, 2.0, 4.0))))) == 1.0


# citations, dedupe, state

def test_resolution_cascade(spark):
    papers = spark.createDataFrame([(1, "A Study of Graph Codes", "10.1/A", None), (2, "Other Work on Trees and Roots", None, "2101.00001"), (3, None, None, None)], "paper_id long, title string, doi string, arxiv_id string")
    edges = spark.createDataFrame([
        (1, 9, None, None, "10.1/a.", None), (2, 9, "x arXiv:2101.00001v2", None, None, None), (3, 9, "A. B., A study of graph codes, 2019", None, None, None),
        (4, 1, None, "a study of graph codes", None, None), (5, 9, "nothing", None, None, None), (6, 9, None, None, None, None),
    ], "edge_id long, src_paper_id long, raw string, title string, doi string, arxiv_id string")
    got = citations.resolve(edges, papers)
    assert rows(got, "edge_id", "outcome") == [(1, "resolved"), (2, "resolved"), (3, "resolved"), (4, "self"), (5, "unresolved"), (6, "unresolved")]
    assert {r.edge_id: r.how for r in got.collect()} == {1: "doi", 2: "arxiv", 3: "title", 4: None, 5: None, 6: None}
    assert citations.resolution_counts(got).first().unresolved == 3


def test_titles_are_found_as_all_titles_are(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "of", "the", "graph", "codes", "study", "neural", "network"])
    titles = [(1, "a study of graph codes"), (2, "a long title that goes on and on for ever"), (3, "a b c d e neuralnetwork of it"), *((10 + k, " ".join(word() for _ in range(rng.randint(4, 9)))) for k in range(40))]
    refs = [(1, "x. a study of graph codes. y"), (2, "a long title that goes on and on, 2020"), (3, "a b c d e neuralnetworks x y z"), (4, "xa study of graph codes"), (5, "a study of, graph codes")]
    refs += [(10 + k, " ".join(word() + rng.choice(["", "", "", ",", ".", "s"]) for _ in range(rng.randint(3, 60)))) for k in range(60)] + [(100 + k, f"q {t}{rng.choice(['', '.', 's', ' more'])}") for k, t in titles]
    refs, titles = spark.createDataFrame(refs, "edge_id long, h string"), spark.createDataFrame(titles, "paper_id long, t string")
    every = refs.crossJoin(titles).where(X.title_matches(F.col("t"), F.col("h"))).select("edge_id", "paper_id")
    got = rows(citations.contained_titles(refs, titles))
    assert got == rows(every) and {(1, 1), (2, 2), (3, 3), (4, 1)} <= set(got) and (5, 1) not in got


def test_containment(spark):
    docs = spark.createDataFrame([(k, f"text {k} with  words\nand more") for k in range(9)] + [(99, None), (3, "text 3 with")], "doc_id long, text string")
    items = [(k, f"{k} with") for k in range(5)] + [(20, "ext 4 with  wor"), (21, "4 with words"), (22, "with"), (23, "7 with  words\nand"), (24, None), (25, " 8 with "), (26, "")]
    items = spark.createDataFrame(items, "item_id long, text string")
    every = rows(docs.crossJoin(items.select("item_id", F.col("text").alias("n"))).where(F.contains("text", "n")).select("item_id", "doc_id"))
    assert rows(citations.containment(docs, items)) == rows(citations.containment(docs, items, max_bytes=12)) == every and (20, 4) in every and (21, 4) not in every


def test_containment_of_long_phrases_and_repeated_rows(spark):
    """Anchors of each length, anywhere in a text; phrases that share words but no run; equal rows and null ids count."""
    words = [f"w{k % 7}x{k * k % 11}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(reversed(words))), (None, "q " + " ".join(words[5:40])), (3, " ".join(words[:9]))], "doc_id long, text string")
    items = [(n * 100 + k, " ".join(words[k : k + n])[1:-1]) for n in range(2, 16) for k in (0, 7, 44)]
    items = spark.createDataFrame([*items, items[-1], (None, " ".join(words[8:20]))], "item_id long, text string")
    every = docs.crossJoin(items.select("item_id", F.col("text").alias("n"))).where(F.contains("text", "n")).select("item_id", "doc_id")
    got = citations.containment(docs, items)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(got) == key(every) and (None, None) in key(got) and key(got).count((1544, 1)) == 2


def test_search_over_any_index_is_the_same(spark):
    chunks = spark.createDataFrame([(k, " ".join(f"t{(k * j) % 13}" for j in range(1, 9))) for k in range(200)], "chunk_id long, text string")
    asked = lexical.query_terms(spark.createDataFrame([(q, f"t{q} t{q + 3} t1") for q in range(9)], "query_id long, text string"))
    dealt = lexical.search(asked, lexical.postings(chunks, wanted=asked), top_k=7, term_logic="any", dealt=True)
    assert rows(dealt) == rows(lexical.search(asked, lexical.postings(chunks), top_k=7, term_logic="any")) and dealt.count() == 63


def _made(df):
    """Rows that each node of a plan made when it ran."""
    out, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            out.append((node.metrics().apply("numOutputRows").value(), node.simpleString(20)))
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return out


def test_search_makes_few_of_the_pairs(spark):
    """Each chunk shares common words with each query, but only a few are near one: the others are never paired."""
    common = [f"c{j}" for j in range(3)]
    chunks = [(k, " ".join([common[k % 3], common[(k + 1) % 3], *(f"q{k // 300}x{j}" for j in range(k % 9 if k % 2 == 0 else 0))])) for k in range(12_000)]
    chunks = spark.createDataFrame(chunks, "chunk_id long, text string")
    asked = lexical.query_terms(spark.createDataFrame([(q, " ".join([*common, *(f"q{q}x{j}" for j in range(8))])) for q in range(40)], "query_id long, text string"))
    got = lexical.search(asked, lexical.postings(chunks, wanted=asked), top_k=1, term_logic="any", dealt=True)
    best = {r.query_id: (r.chunk_id, r.matched) for r in got.collect()}
    assert best == {q: (min(k for k in range(300 * q, 300 * q + 300) if k % 2 == 0 and k % 9 == 8), 10) for q in range(40)}
    most = max(_made(got))
    assert most[0] < 40 * 12_000 / 4, most


@pytest.mark.parametrize("logic", ["any", "all"])
def test_search_finds_what_all_pairs_give(spark, logic):
    """Repeated and null ids of queries and chunks, many ties, and queries in several blocks."""
    draw = random.Random(5)
    text = lambda n: " ".join(f"t{int(draw.paretovariate(0.7)) % 60}" for _ in range(n))
    chunks = [(k // 2 if k % 50 == 0 else k, text(draw.randint(0, 25))) for k in range(1500)] + [(None, text(9)), (None, text(9))]
    queries = [(q, text(draw.randint(0, 12) if logic == "any" else 2)) for q in range(30)] + [(7, "t1 t2 t9"), (None, "t3 t1")]
    chunks, queries = spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    asked = lexical.query_terms(queries).where("query_id IS NULL OR query_id <> 7 OR n_terms = 3" if logic == "all" else "true")
    found = lexical.postings(chunks).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf"), F.first("n_terms").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("tf"), "chunk_id")
    every = found.where("matched = n" if logic == "all" else "true").withColumn("rank", F.row_number().over(order)).where("rank <= 6").drop("n")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for more in ({}, {"max_terms": 40}):
        assert key(lexical.search(asked, lexical.postings(chunks, wanted=asked), top_k=6, term_logic=logic, dealt=True, **more)) == key(every)


def test_paragraph_ids_are_a_papers_own(spark):
    from lectern.sources import tables

    made = tables.paragraphs(spark.createDataFrame([(1, "x\n" * 120_000), (2, "y")], "paper_id long, text string"))
    assert made.select("paragraph_id").distinct().count() == 120_001 and made.where("paper_id = 2").first().paragraph_id == 2 * tables.STRIDE


def test_import_plan(spark):
    schema = "external_id string, sha256 string, title string"
    batch = spark.createDataFrame([("n", "s1", "New", 0), ("m", "s1", "New 2", 1), ("x", "ex", "Bad", 2), ("a", "s9", "Zed", 3), ("t", "s8", "Held Out Title", 4)], schema + ", pos int")
    known = spark.createDataFrame([("a", "k1", "Alpha", "dev"), ("h", "k2", "held out title", "holdout")], schema + ", split string")
    got = {r.external_id: (r.action, r.reason) for r in dedupe.import_plan(batch, known, spark.createDataFrame([("ex",)], "sha256 string")).collect()}
    assert got == {"n": ("add", None), "m": ("skip", "repeated in batch"), "x": ("skip", "excluded content"), "a": ("skip", "known id"), "t": ("block", "title twin is held out")}


def test_state(spark):
    schema = "external_id string, sha256 string, parser string"
    now = spark.createDataFrame([("a", "1", "hybrid:x-only", "ok", None), ("b", "1", "hybrid", "quarantined", "bad"), ("c", "1", "hybrid", "ok", None)], schema + ", status string, reason string")
    new = spark.createDataFrame([("a", "1", "hybrid"), ("b", "1", "hybrid"), ("d", "1", "hybrid")], schema)
    assert rows(state.classify(now, new)) == [("a", "unchanged"), ("b", "replace"), ("c", "absent"), ("d", "insert")]
    parsed = new.withColumn("error", F.when(F.col("external_id") == "d", F.repeat(F.lit("e"), 3000)))
    after = {r.external_id: (r.status, len(r.reason or "")) for r in state.merged(now, parsed).collect()}
    assert after == {"a": ("ok", 0), "b": ("ok", 0), "c": ("ok", 0), "d": ("quarantined", 2000)}


def test_split_fails_closed(spark):
    papers = spark.createDataFrame([(1,), (2,), (3,)], "paper_id long")
    split = spark.createDataFrame([(1, "dev"), (2, "holdout")], "paper_id long, split string")
    assert rows(splits.dev_only(papers, split)) == [(1,)]
    assert rows(splits.dev_only(papers, split, include_holdout=True)) == [(1,), (2,)]
    assert rows(splits.unassigned(papers, split)) == [(3,)]


# guards, quality, layout

def test_guards(spark):
    used, held = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",)], "id string")
    guards.assert_no_holdout(used, held, phase=6)
    with pytest.raises(guards.HoldoutLeak, match="b"):
        guards.assert_no_holdout(used, held, phase=2)
    good = {"status": "frozen", "frozen_date": "2024-01-01", "fields": [{"name": "x"}]}
    assert guards.check_schema(good) == good
    for fault in ({"status": "draft"}, {"frozen_date": "soon"}, {"fields": []}, {"fields": [{"name": "x"}, {"name": "x"}]}, {"comparison_table_default_columns": ["y"]}):
        with pytest.raises(guards.UnfrozenSchema):
            guards.check_schema(good | fault)


def test_questions(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    line = '{"id": "%s", "question": "Why?", "type": "%s", "spans": %s}\n'
    span = '[{"paper_external_id": "p", "relevance": 0.5}]'
    path.write_text("// note\n\n" + line % ("a", "numeric", span) + line % ("b", "unanswerable", "[]"))
    assert rows(files.read_questions(spark, str(path)), "id") == [("a",), ("b",)]
    for bad in (line % ("a", "numeric", "[]"), line % ("a", "unanswerable", span), line % ("a", "odd", span), "{nope\n", line % ("", "numeric", span)):
        path.write_text("// note\n" + bad)
        with pytest.raises(files.InvalidInput, match=":2:"):
            files.read_questions(spark, str(path))
    path.write_text((line % ("a", "numeric", span)) * 2)
    with pytest.raises(files.InvalidInput, match="2 times"):
        files.read_questions(spark, str(path))
    path.write_text("\n")
    with pytest.raises(files.InvalidInput):
        files.read_questions(spark, str(path))
    with pytest.raises(files.InvalidInput, match="stub"):
        files.read_questions(spark, str(tmp_path / "q_STUB.jsonl"))


def test_lists_and_manifest(spark, tmp_path):
    path = tmp_path / "ids.txt"
    path.write_text("# head\n a \nb # tail\n\na\n")
    assert rows(files.read_id_list(spark, str(path))) == [("a",), ("b",)]
    path.write_text("# none\n")
    with pytest.raises(files.InvalidInput):
        files.read_id_list(spark, str(path))
    (tmp_path / "one.pdf").write_bytes(b"abc")
    got = files.build_manifest(spark, str(tmp_path)).first()
    assert (got.external_id, got.filename, got.size_bytes) == ("one", "one.pdf", 3)
    assert got.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    with pytest.raises(files.InvalidInput):
        files.build_manifest(spark, str(tmp_path), "*.doc")


@pytest.mark.parametrize("grid, tabular", [
    ([["m", "a", "b"], ["x", "1", "2"], ["y", "3", "4"]], True), ([["UT", "", "", ""], ["", "Transfo", "", ""]], False),
    ([["a", "b", "c", "d"], ["1", "2", "3", "4"]], True), ([["a"]], False), ([["a", ""], ["b", ""], ["c", ""]], False), ([], False),
])
def test_tabular(spark, grid, tabular):
    df = spark.createDataFrame([(grid,)], "g array<array<string>>")
    assert df.select(quality.looks_tabular(F.col("g")).alias("x")).first().x is tabular


def test_cells_and_boxes(spark):
    df = spark.createDataFrame([([["0.1 0.2 0.3"]],), ([["0.1", "0.2"]],)], "g array<array<string>>")
    assert [r.x for r in df.select(quality.merged_cells(F.col("g")).alias("x")).collect()] == [True, False]
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 1.0, 5.0, 5.0), (1, 3, 20.0, 0.0, 30.0, 5.0)], "page_id long, box_id long, x0 double, y0 double, x1 double, y1 double")
    assert rows(quality.largest_without_overlap(boxes)) == [(1, 1), (1, 3)]
    lines = spark.createDataFrame([(1, 0, 0.0, 12.0, 9.0, 13.0, "TABLE II. Results"), (1, 1, 0.0, 14.0, 9.0, 15.0, "Table 3")], "page_id long, ordinal int, x0 double, y0 double, x1 double, y1 double, text string")
    assert rows(quality.captions_near(boxes.where("box_id = 1"), lines), "label", "caption") == [("Table II", "Results")]


def test_spans_out_of_range(spark):
    par = spark.createDataFrame([(1, "abcdef")], "paragraph_id long, text string")
    chunks = spark.createDataFrame([(7, 0, "abc")], "paper_id long, ordinal int, text string")
    spans = spark.createDataFrame([(7, 0, 1, 0, 3), (7, 0, 1, 0, 9), (7, 0, 1, 3, 6)], "paper_id long, ordinal int, paragraph_id long, char_start int, char_end int")
    assert rows(quality.span_faults(spans, par, chunks), "fault") == [("not contained",), ("range",)]


def test_crash_is_a_finding(spark):
    def broken():
        raise RuntimeError("boom")

    assert quality.run_checks({"a": lambda: spark.range(0), "b": lambda: spark.range(2), "c": broken}) == [("a", "ok", 0), ("b", "violated", 2), ("c", "crashed", "boom")]


def test_layout(spark):
    data = [(1, 0, "A Study of Many Things", 20.0, False, 1), (1, 1, "IEEE Transactions on Testing (2021)", 9.0, False, 1), (1, 2, "Abstract", 10.0, True, 1), (1, 3, "We look at commu-", 10.0, False, 1), (1, 4, "nication in 2021.", 10.0, False, 1), (1, 5, "II. SYSTEM MODEL", 10.0, True, 2), (1, 6, "Body text.", 10.0, False, 2)]
    lines = spark.createDataFrame(data, "doc_id long, pos int, text string, size double, bold boolean, page int")
    got = {r.heading: (r.kind, r.text) for r in layout.sections(lines).collect()}
    assert got["Abstract"] == ("abstract", "We look at communication in 2021.") and got["II. SYSTEM MODEL"] == ("body", "Body text.")
    front = layout.front_matter(lines).first()
    assert (front.title, front.venue, front.year) == ("A Study of Many Things", "IEEE Transactions on Testing", 2021)
    assert one(spark, layout.inline_abstract(F.lit("Abstract—We do. Index Terms—x"))) == "We do."
    assert one(spark, layout.split_references(F.lit("[1] First work\n[2] Second work"))) == ["First work", "Second work"]
    assert one(spark, layout.split_references(F.lit("short\n" + "x" * 30))) == ["x" * 30]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A  Title</title></titleStmt><publicationStmt><date when="2020-05-01"/></publicationStmt>
<sourceDesc><biblStruct><monogr><title level="j">Journal</title></monogr><idno type="DOI">10.1/x</idno></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>Short abstract.</p></abstract></profileDesc></teiHeader>
<text><body><div><head n="2.1">Model</head><p>First.</p><formula>y = x</formula><p>Last.</p></div><figure><head>Fig. 1</head><figDesc>Shows it.</figDesc></figure><note>tiny</note><note>A longer note.</note></body>
<back><div><listBibl><biblStruct><analytic><title level="a">Cited</title></analytic><idno type="arXiv">2101.00001</idno></biblStruct></listBibl></div></back></text></TEI>"""


def test_tei(spark):
    got = {r.external_id: r for r in markup.parse_tei(spark.createDataFrame([("a", TEI), ("b", "<x"), ("c", "<TEI/>"), ("d", None)], "external_id string, tei string")).collect()}
    a = got["a"]
    assert (a.title, a.year, a.venue, a.doi, a.error) == ("A Title", 2020, "Journal", "10.1/x", None)
    assert [(s.kind, s.depth, [p.text for p in s.paragraphs]) for s in a.sections] == [("abstract", 0, ["Short abstract."]), ("body", 1, ["First.", "y = x", "Last."]), ("figure_caption", 0, ["Fig. 1 Shows it."]), ("note", 0, ["A longer note."])]
    assert a.sections[3].paragraphs[0].ordinal == 1 and a.references[0].arxiv_id == "2101.00001"
    assert all(got[k].error for k in "bcd")
    parsed = markup.parse_tei(spark.createDataFrame([("a", TEI)], "external_id string, tei string"))
    parts = state.structure_of(parsed)
    assert parts["paragraphs"].count() == 6 and parts["edges"].count() == 1 and parts["sections"].count() == 4
    failed = markup.parse_tei(spark.createDataFrame([("a", "<x")], "external_id string, tei string"))
    assert markup.hybrid(failed, parsed).first().parser == "hybrid:tei-only"
    assert markup.hybrid(parsed, parsed).first().parser == "hybrid"


def test_contradictions(spark):
    records = spark.createDataFrame([(1, "m", "s", 1.0), (2, "m", "s", 1.05), (3, "m", "s", 2.0), (4, "m", None, 9.0)], "paper_id long, metric string, setup string, value double")
    limits = spark.createDataFrame([("m", "absolute", 0.1)], "metric string, kind string, tolerance double")
    assert rows(comparison.contradictions(records, ["setup"], limits), "paper_a", "paper_b") == [(1, 3), (2, 3)]


def test_config():
    base = RunConfig()
    assert len(base.fingerprint()) == 16 and RunConfig(notes="x", justified=("a",)).fingerprint() == base.fingerprint()
    other = RunConfig(retrieval=RetrievalConfig(top_k=9))
    assert other.fingerprint() != base.fingerprint() and other.chunk_fingerprint() == base.chunk_fingerprint()
    assert RunConfig(chunking=ChunkConfig(chunk_tokens=9)).chunk_fingerprint() != base.chunk_fingerprint()
    assert other.unjustified() == ["retrieval.top_k"]
    with pytest.raises(ValueError):
        RunConfig(retrieval=RetrievalConfig(mode="bm25"))


def test_incremental_stream(spark, tmp_path):
    from lectern.streaming.incremental import STATE, documents_stream, ingest

    source, target = tmp_path / "in", str(tmp_path / "state")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "a", "en", "s", 1), (2, "", "en", "s", 0)], schema).coalesce(1).write.parquet(str(source))
    ingest(documents_stream(spark, str(source)), target, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(1, "b", "en", "s", 1)], schema).coalesce(1).write.mode("append").parquet(str(source))
    ingest(documents_stream(spark, str(source)), target, str(tmp_path / "c")).awaitTermination()
    got = {r.external_id: r.status for r in spark.read.schema(STATE).parquet(target + "/v1").collect()}
    assert got == {"doc-1": "ok", "doc-2": "quarantined"}
