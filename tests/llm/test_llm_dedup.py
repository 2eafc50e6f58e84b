"""Near-duplicates, decontamination and line templates against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import components, decontaminate as dec, minhash_dedup as mh, template_lines as tl


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("id", "n", "key", "pivot", "leaf", "items", "line")})


def classes(rows, width, percent):
    """Component ids by comparing all pairs of full sets."""
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if (sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])) or rows[a][0] == rows[b][0]:
            root[find(b)] = find(a)
    least = {}
    for k, (name, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), name), name)
    return sorted((name, len(sets[k]), least[find(k)], name == least[find(k)]) for k, (name, _) in enumerate(rows))


def family(seed, n, edits):
    """Copies of one text with a few words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_same_components_as_all_pairs(spark, width):
    texts = [t for s in range(4) for t in family(s, 12, 7)] + [None, "", "  ", "one", "One", "one two", "ONE two", "É a", "é a", "long " * 3000, "Long " * 3000]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    assert sorted(map(tuple, mh.near_dedup(table(spark, rows), width=width).collect())) == classes(rows, width, 80)


def test_tiles_find_what_pairs_find(spark, monkeypatch):
    rows = list(enumerate(family(9, 60, 9)))
    expected = classes(rows, 4, 80)
    assert len({c for _, _, c, _ in expected}) > 2  # some are outliers
    assert sorted(map(tuple, mh.near_dedup(table(spark, rows), width=4).collect())) == expected
    monkeypatch.setattr(mh, "PAIRS", 0)
    monkeypatch.setattr(mh, "TILE", 16)
    assert sorted(map(tuple, mh.near_dedup(table(spark, rows), width=4).collect())) == expected


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = list(enumerate(family(5, 12, 5)))
    monkeypatch.setattr(mh, "FILTER_BITS", 6)
    assert sorted(map(tuple, mh.near_dedup(table(spark, rows), width=4).collect())) == classes(rows, 4, 80)


def test_repeated_ids_nulls_and_nothing(spark):
    got = mh.near_dedup(table(spark, [(5, "a b c d e"), (5, "v w x y z"), (7, "v w x y z"), (None, "v w x y z"), (None, "alone it is")]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (None, 1, 5, False), (None, 1, None, True)], key=repr)
    assert mh.near_dedup(table(spark, [(1, "a")]).where("false")).count() == 0


def test_pruning_keeps_what_may_be_similar():
    bounds = mh.prune_below(0.8, 1e-6)
    assert len(bounds) == mh.EXTRA // 16 and all(a <= b for a, b in zip(bounds, bounds[1:]))
    rng = np.random.default_rng(0)
    agree = rng.random((20000, mh.EXTRA)) < 0.8
    alive = np.ones(len(agree), bool)
    for k, least in enumerate(bounds):
        alive &= agree[:, : 16 * (k + 1)].sum(axis=1) >= least
    assert alive.mean() > 0.999
    assert bounds[-1] > 0.5 * mh.EXTRA


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 300 + k) for k in range(50)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200, **{300 + k: 200 for k in range(50)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(docs, items, window):
    pattern, lower = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = lambda t: pattern.findall((t or "").encode().translate(lower))
    found: dict = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n and name is not None else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    out = []
    for name, text in docs:
        w, hit, own = words(text), set(), set()
        for size in {len(x) for x in found}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in found:
                    own |= found[tuple(w[k : k + size])]
                    hit.update(range(k, k + size))
        out.append((name, len(w), len(hit), sorted(own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [10**6, 7])
def test_decontamination(spark, blocks):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate([30, 12, 10, 9, 3, 2, 1, 0, 15])] + [(3, prose(11)), (None, prose(12)), (20, None), (21, "!!"), (22, "Größe, naïve-Ünits 5 6 7 8 9 10 11 12")]
    docs = [(k, f"{prose(rng.randint(0, 8))} {rng.choice(items)[1]}. {prose(rng.randint(0, 8))}") for k in range(40)]
    docs += [(100, None), (101, ""), (102, "größe naïve ünits 5 6 7 8 9 10 11 12"), (7, "again"), (7, items[0][1]), (103, prose(9)), (104, prose(5000))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1))
    got = dec.decontaminate(table(spark, docs), bench, max_windows=blocks)
    own = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got.collect()), key=repr)
    assert own == brute(docs, items, 10)
    for r in got.collect():
        assert sum(s.end - s.begin for s in r.spans) == r.n_hit


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = dec.decontaminate(table(spark, [(1, "a b"), (2, None)]), bench)
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in got.collect()) == [(1, 2, 0), (2, 0, 0)]
    assert dec.decontaminate(table(spark, [(1, "a")]).where("false"), bench).count() == 0


def templates(docs, depth=3, similarity=0.5, min_docs=2, short_tokens=8, short_docs=3):
    """The lines to drop, by the definition."""
    lines = []
    for name, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            tokens = ["<*>" if re.search(r"\d", w) else w for w in line.split()]
            if tokens:
                lines.append((name, k, tokens, (len(tokens), *tokens[:depth])))
    seen: dict = {}
    for name, _, tokens, leaf in lines:
        for at, w in enumerate(tokens):
            seen.setdefault((leaf, at, w), set()).add(name)
    shaped = []
    for name, k, tokens, leaf in lines:
        kept = [w if w != "<*>" and len(seen[leaf, at, w]) > 1 else "<*>" for at, w in enumerate(tokens)]
        many = sum(w != "<*>" for w in kept) >= similarity * len(kept)
        shaped.append((name, k, len(tokens), " ".join(kept) if many else None))
    docs_of: dict = {}
    for name, _, _, t in shaped:
        docs_of.setdefault(t, set()).add(name)
    return sorted((name, k) for name, k, n, t in shaped if t and len(docs_of[t]) >= (min_docs if n >= short_tokens else short_docs))


def test_line_templates(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["the", "of", "a", "alpha", "beta", "gamma", "delta"]) for _ in range(n))
    passage = prose(60)
    docs = [(k, "\n".join([prose(rng.randint(1, 30)), f"User{k} signed in from host {k} at port {k * 7} today again", f"The host named {rng.choice('xyz')} went away at night for good {k}", "All rights reserved.", "", "  "] + [passage] * (k < 2))) for k in range(12)]
    docs += [(50, None), (51, ""), (52, passage), (53, "only here it is said in so many words by one")]
    got = tl.recurring_lines(table(spark, docs))
    assert sorted((r.doc_id, r.line) for r in got.where("dropped").collect()) == templates(docs)
    report = {r.doc_id: r for r in tl.line_report(table(spark, docs)).collect()}
    assert report[50].n_lines == report[51].n_lines == 0 and report[52].n_dropped == 1 and report[53].n_dropped == 0
    kept = {r.doc_id: r.text for r in tl.drop_lines(table(spark, docs), got).collect()}
    assert passage not in kept[0] and "reserved" not in kept[0] and kept[52] == "" and kept[53] == docs[-1][1] and kept[50] is None
    assert tl.line_report(table(spark, docs).where("false")).count() == 0


def test_a_full_leaf_filter_changes_nothing(spark, monkeypatch):
    docs = [(k, f"Job {k} is done by now\nall rights are reserved by us {k} for ever and ever\nalone {'x' * k} here") for k in range(6)]
    monkeypatch.setattr(tl, "FILTER_BITS", 6)
    got = tl.recurring_lines(table(spark, docs))
    assert sorted((r.doc_id, r.line) for r in got.where("dropped").collect()) == templates(docs)


@pytest.mark.parametrize("chunk", [8192, 16])
def test_a_template_of_few_rows_is_one_of_many(spark, monkeypatch, chunk):
    monkeypatch.setattr(tl, "CHUNK_LINES", chunk, raising=False)
    rng = random.Random(9)
    names = [f"{a}{b}" for a in "bdfgklmnpr" for b in ("an", "el", "io", "um")]
    pick = lambda: rng.choice(names)
    for n in (20, 200, 2000):
        docs = [(k, f"Thank you for reading this report by {pick()} of {pick()} bureau in {pick()} with all rights reserved") for k in range(n)]
        alone = "Thank you for " + " ".join(f"w{chr(97 + k)}" for k in range(14))  # same leaf, nothing else in common
        got = tl.line_report(table(spark, [*docs, (n, alone)])).collect()
        assert sorted(r.doc_id for r in got if not r.n_dropped) == [n]
        assert {r.template for r in tl.recurring_lines(table(spark, docs)).select("template").distinct().collect()} == {"Thank you for reading this report by <*> of <*> bureau in <*> with all rights reserved"}


def test_passages_inside_longer_lines(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    sentences = lambda *sizes: " ".join(prose(n).capitalize() + "." for n in sizes)
    passage, run = sentences(14, 5, 20, 16), prose(300)  # a run without an end of sentence is cut by content
    docs = [(k, f"{sentences(9, 12, 30)} {passage} {sentences(11, 8 + k)}\n{sentences(10)}") for k in range(3)]
    docs += [(10 + k, f"{prose(20 + 7 * k)} {run} {prose(30)}") for k in range(2)] + [(20, sentences(12, 13, 14, 15)), (21, passage)]
    got = tl.recurring_lines(table(spark, docs))
    report = {r.doc_id: r for r in tl.line_report(table(spark, docs)).collect()}
    kept = {r.doc_id: r.text for r in tl.drop_lines(table(spark, docs), got).collect()}
    for k, text in docs[:3]:
        assert kept[k] == text.replace(passage + " ", "") and report[k].n_dropped == 0 and report[k].n_passages == 1
        assert report[k].dropped_passages == "0:51-106" and report[k].n_words_dropped == 55
    for k in (10, 11):
        assert report[k].n_dropped == 0 and 300 - 2 * 64 <= report[k].n_words_dropped <= 300
        assert all(w in run for w in set(dict(docs)[k].split()) - set(kept[k].split()))
    assert kept[20] == docs[-2][1] and report[20].n_passages == 0 and kept[21] == "" and report[21].n_passages == 1


def plain_segments(text, passage_words):
    """Lines and segments by the definition, one token after the other."""
    out = []
    for number, line in enumerate(text.split("\n")):
        tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not tokens:
            continue
        out.append((number, 0, 0, len(tokens)))
        if len(tokens) < passage_words:
            continue
        data = np.frombuffer(" ".join(tokens).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) + 1 for w in tokens]) - 1
        value = [tl._VARIABLE_HASH if re.search("[0-9]", w) else h for w, h in zip(tokens, tl.hash_spans(data, ends - [len(w.encode()) for w in tokens], ends))]
        cut = [k for k, w in enumerate(tokens, 1) if re.search("[.!?…][\"')\\]}»”’]{0,4}$", w) or k == len(tokens)]
        edges = [0]
        for end in cut:
            if end - edges[-1] > tl.LONG_SENTENCE:
                for k in range(edges[-1], end):
                    near = range(max(0, k - tl.CUT_REACH), min(len(tokens), k + tl.CUT_REACH + 1))
                    equal = next(n for n in range(k + 1) if k == n or value[k - n - 1] != value[k])
                    least = all(value[k] < value[j] if j < k else value[k] <= value[j] for j in near if j != k)
                    if (least or equal % tl.CUT_REACH == tl.CUT_REACH - 1) and k + 1 != end:
                        edges.append(k + 1)
            edges.append(end)
        out += [(number, part, a, b - a) for part, (a, b) in enumerate(zip(edges, edges[1:]), 1)]
    return out


def test_units_are_those_of_the_definition():
    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "é", "b", "x1", "12", "end.", "why?)", "so…”", "(a.)", "...", "!\"''')", "!\"''')]", "la", "la", "la", "gamma"] * 1 + ["plain"] * rng.choice([1, 60]))
    texts = ["", "\n\n", "one", "a\n", " \t\n x y"] + ["\n".join(" ".join(word() for _ in range(rng.choice([0, 3, 24, 25, 90, 300]))) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    got = sorted((r["id"], r["line"], r["part"], r["first"], r["n"]) for out in tl._units(3, 0.5, 24)(iter([batch])) for r in out.to_pylist())
    assert got == sorted((k, *x) for k, t in enumerate(texts) for x in plain_segments(t, 24))


def test_lines_nulls_and_repeated_rows(spark):
    long = "Some words that are said again and again by all of the people here, of whom there are more than a few today."
    rows = [(1, long), (1, long), (None, long), (None, "alone it stands in here so that nobody else has it"), (2, None), (3, "\n \n"), (4, "x " * 40_000)]
    report = sorted((tuple(r) for r in tl.line_report(table(spark, rows)).collect()), key=repr)
    by = {r[0]: r for r in report}
    assert len(report) == len(rows) and by[1][1:5] == (2, 2, 46, "0") and by[2][1] == by[3][1] == 0 and by[4][1:3] == (1, 0)
    lines = tl.recurring_lines(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.dropped) for r in lines if r.doc_id) == [(1, True), (1, True), (4, False)] and sum(r.doc_id is None and r.dropped for r in lines) == 1
