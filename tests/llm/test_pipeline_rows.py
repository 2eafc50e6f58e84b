"""Each stage of the pipeline on odd rows: nulls, empty tables, repeated ids and rows, clashing columns, long texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the evil queen and jack"


def rows(spark, extra=()):
    rng = random.Random(8)
    vocabulary = {"en": "the of and to in that with from water house", "de": "der die und das nicht mit wasser haus über groß"}
    out = []
    for k in range(400):
        lang = rng.choice(list(vocabulary))
        text = " ".join(rng.choice(vocabulary[lang].split()) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(20, 60)))
        out.append((k, text, lang, rng.choice(["a", "b", None]), len(text)))
    return spark.createDataFrame([*out, *extra], SCHEMA), out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, PASSAGE), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("k", range(5))
def test_empty_tables(spark, folder, k):
    docs = spark.createDataFrame([], SCHEMA)
    out = cp.STAGES[k][1](spark, docs, folder)
    assert out.count() == 0
    if k < 4:
        assert out.columns == cp.COLUMNS


@pytest.mark.parametrize("k", range(5))
def test_clashing_columns_and_nulls_everywhere(spark, folder, k):
    docs, _ = rows(spark, [(None, None, None, None, None)] * 3 + [(7, "", None, None, None)])
    docs = docs.withColumns({c: F.lit("x") for c in ("id", "row", "_row", "key", "leaf", "part", "shard", "n_hit", "kept", "score", "coverage", "lang_pred", "_digest")})
    out = cp.STAGES[k][1](spark, docs, folder)
    assert out.count() > 100 and (k == 4 or out.columns == cp.COLUMNS)


def test_language_keeps_rows_with_a_language(spark, folder):
    docs, own = rows(spark, [(None, "the water of the house and that water", None, "a", 1), (5, "12 34", None, "a", 5), (6, None, "en", "a", 0), (8, "the of and to", "en", "a", 9), (8, "the of and to", "en", "a", 9)])
    out = [(r.doc_id, r.text, r.lang) for r in cp.language_id(spark, docs, folder).collect()]
    assert len(out) == 400 + 1 + 2 and (None, "the water of the house and that water", "en") in out and {t for _, t, _ in out if not t} == set()
    assert all(lang == dict((x[0], x[2]) for x in own)[k] for k, t, lang in out if k is not None and k not in (5, 6, 8))


def test_near_duplicates_keep_one_of_each(spark, folder):
    docs, own = rows(spark)
    twin = own[3][1]
    docs = docs.unionByName(spark.createDataFrame([(900, twin, "en", "a", 1), (901, twin + " end", "en", "a", 1), (None, twin, "en", "a", 1), (None, "nobody has this one here at all", "en", "a", 1), (902, None, "en", "a", 0), (903, "", "en", "a", 0), (904, "word " * 50_000, "en", "a", 1), (905, "word " * 50_000, "en", "a", 1)], SCHEMA))
    kept = [r.doc_id for r in cp.near_duplicates(spark, docs, folder).collect()]
    assert set(range(400)) | {902, 903, 904, None} == set(kept) and kept.count(None) == 2


def test_decontamination_drops_what_is_hit(spark, folder):
    docs, _ = rows(spark, [(900, f"before {PASSAGE} after", "en", "a", 1), (None, f"no id {PASSAGE.upper()}", "en", "a", 1), (None, "no id and clean", "en", "a", 1), (901, None, "en", "a", 0), (902, " ".join(PASSAGE.split()[:9]), "en", "a", 1)])
    kept = [(r.doc_id, r.text) for r in cp.benchmark_decontamination(spark, docs, folder).collect()]
    assert {k for k, _ in kept} == set(range(400)) | {None, 901, 902} and [t for k, t in kept if k is None] == ["no id and clean"]


def test_mix_and_shards_hold_all_rows(spark, folder):
    docs, own = rows(spark, [(None, "no id of its own here " * 40, "en", "b", 1), (7, "again " * 30, "en", "a", 1), (7, "again " * 30, "en", "a", 1), (901, None, "en", "a", 0)])
    mixed = cp.source_mixing(spark, docs, folder).persist()
    size = lambda t: len((t or "").split())
    total = sum(size(r.text) for r in docs.collect())
    taken = [(r.doc_id, size(r.text)) for r in mixed.collect()]
    assert abs(sum(n for _, n in taken) - 1.5 * total) <= 3 and {k for k, n in taken} <= set(range(400)) | {None} and any(k is None for k, _ in taken)
    for k, text, *_ in own[:50]:
        assert sum(n for j, n in taken if j == k) <= 2 * size(text) + (120 if k == 7 else 0)
    out = cp.token_id_output(spark, mixed, folder).orderBy("start").collect()
    assert len(out) == mixed.count() and all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:])) and [r.doc_id for r in out][:1] == [None]
