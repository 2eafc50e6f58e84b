"""Mixing, HTML, JPEG, language and URL operators, and the pipeline's stages."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import struct
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import html_graph, language_bloom as lb, mixing, progressive_jpeg as pj, url_markov as um

sys.path.insert(0, os.path.dirname(__file__))
import layouts  # noqa: E402

# mixing


def level(sizes, weights, total, repeat):
    """Targets by sharing the excess again and again."""
    target, full = [0.0] * len(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in full]
        left = total - sum(repeat * sizes[k] for k in full)
        share = sum(weights[k] for k in free)
        target = [repeat * sizes[k] if k in full else left * weights[k] / share for k in range(len(sizes))]
        more = {k for k in free if target[k] > repeat * sizes[k]}
        if not more:
            return target
        full |= more


def mixed_rows(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("w" for _ in range(rng.choice([0, 1, 5, 80, 900]))), rng.choice(["b", "a", "é", "Z", None])) for k in range(300)]
    rows += [(1000, None, "a"), (1001, " \t\n", "nothing"), (7, "again again", "a"), (7, "again again", "a"), (None, "no id here", "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("row", "rank", "size", "block", "id")})


def test_mix_meets_its_targets(spark):
    rows, df = mixed_rows(spark)
    got = mixing.taken_words(*mixing.mix(df)[:2]).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, level([sizes[n] for n in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes.values()), 2)))
    by_size, taken = {sizes[n]: targets[n] for n in names}, Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size]) and r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
    for size, target in by_size.items():
        assert taken[size] == math.floor(target)
    again = mixing.taken_words(*mixing.mix(df.repartition(3, "text"))[:2]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_every_block_once_before_any_twice(spark):
    df = spark.createDataFrame([(k, "w " * 700, "s") for k in range(30)], "doc_id long, text string, source string")
    _, pieces, _ = mixing.mix(df, share=1.4)
    words = Counter()
    for p in pieces.collect():
        words.update((p.id, w, p.epoch) for w in range(p["first"], p["last"]))
    assert set(words.values()) == {1}
    assert {(k, w) for k, w, e in words if e == 0} == {(k, w) for k in range(30) for w in range(700)}


def test_drawn_counts_are_what_shards_hold(spark):
    """Full shards, sources in proportion and not all alike, each slot once; the pieces follow the draw."""
    df = spark.createDataFrame([(k, "w " * 500, "abc"[k % 3]) for k in range(300)], "doc_id long, text string, source string")
    plan, pieces, draws = mixing.mix(df, share=1.5, shard_blocks=50)
    drawn = {(r.shard, r.source): (r.n, r["first"]) for r in draws.collect()}
    target = {r.source: r.target for r in plan.select("source", "target").distinct().collect()}
    slots = {s: math.ceil(math.floor(t) / 128) if t < 50_000 else 390 + math.ceil((math.floor(t) - 50_000) / 128) if t < 100_000 else 782 for s, t in target.items()}
    shards = Counter()
    for (shard, _), (n, _) in drawn.items():
        shards[shard] += n
    assert sorted(shards) == list(range(len(shards))) and all(shards[k] == 50 for k in range(len(shards) - 1)) and 0 < shards[len(shards) - 1] <= 50
    for source in "abc":
        own = sorted((shard, n, first) for (shard, s), (n, first) in drawn.items() if s == source)
        at = 0
        for _, n, first in own:
            assert first == at
            at += n
        assert abs(at - slots[source]) <= 1
        share = at / sum(shards.values())
        spread = [(n - 50 * share) / math.sqrt(50 * share * (1 - share)) for shard, n, _ in own if shards[shard] == 50]
        assert len({n for _, n, _ in own}) > 3 and 0.5 < np.std(spread) < 1.5 and max(map(abs, spread)) < 5
    held = defaultdict(set)
    names = dict(map(tuple, df.select("doc_id", "source").collect()))
    for p in pieces.collect():
        held[p.shard, names[p.id]].add(p.slot)
    assert {k: (len(v), min(v)) for k, v in held.items()} == drawn


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97])
def test_permutation(spark, n):
    got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n), F.lit(5)).alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(n))


def test_mixed_documents(spark):
    text = "One  two\nthree four. " * 25
    rows = [(1, text, "en", "a", 5), (2, "b " * 300, "en", "b", 5), (3, None, "en", "a", 0), (None, "no id of " * 30, "en", "b", 9), (7, "x y z", "en", "a", 1), (7, "u v", "fr", "b", 1), (8, "w" * 50_000 + " end", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_documents(df, share=1.2, shard_blocks=3, shard_col="shard").collect()
    words, size = Counter(), Counter()
    for r in rows:
        size[r[0], r[2]] += len((r[1] or "").split())
    for r in got:
        assert r.n_chars == len(r.text) and r.text in {x[1] for x in rows} | {t for x in rows for t in [r.text] if x[1] and t in x[1]}
        words[r.doc_id, r.lang] += len(r.text.split())
    assert abs(sum(words.values()) - 1.2 * sum(size.values())) <= 2
    assert all(words[k] <= 2 * n for k, n in size.items()) and words[None, "en"] >= 1 and (3, "en") not in words
    assert len({r.shard for r in got}) >= 2
    clash = df.withColumns({c: F.lit(1) for c in ("row", "slot", "_row", "first", "size", "_words_")})
    assert mixing.mixed_documents(clash).columns == clash.columns
    assert mixing.mixed_documents(df.where("false")).count() == 0
    assert mixing.taken_words(*mixing.mix(df.where("false"))[:2]).count() == 0


def test_mix_of_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "v", "a"), (3, "u " * 50, "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.taken_words(*mixing.mix(df)[:2]).collect()}
    assert got[1].taken + got[2].taken == math.floor(got[1].target) and got[3].taken == math.floor(got[3].target) == 100 and got[1].taken <= 600_000


def test_native(spark):
    rows, df = mixed_rows(spark)
    plans = [mixing.mix(df)[1], mixing.mixed_documents(df.select("doc_id", "text", "source")), um.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), um.fit(spark.createDataFrame([(f"http://a{k}.{'net' if k % 2 else 'org/fr/'}", k % 2 == 0) for k in range(40)], "url string, accepted boolean")))]
    for plan in plans:
        assert not re.search("Python|Pandas|Arrow|MapIn", plan._jdf.queryExecution().executedPlan().toString())


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header><h1>Site name</h1><a href=/>Home</a></header><nav><ul><li><a href=x>One</a><li><a>Two</a></ul></nav>
<div class="cookie-banner"><p>We use cookies to make this site better.</p></div><div class="ad">Buy now, it is cheap.</div><article><h1>The &Eacute;tude &amp; more</h1><p>First <b>bold<br>text</b> here.<p>Second&nbsp;one &lt;tag&gt; is
 here.</p><p>Ok.</p><ul><li>Item one.</li><li>Item two.</li></ul><form><label>Mail</label><input></form></article><aside class="sidebar"><h3>Related</h3><p>Other story here.</p></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this very much, thanks for the long read.</p></div></section><footer>&copy; Site. All rights reserved.</footer></body></html>"""


def test_page():
    assert html_graph.extract_text(PAGE) == "The Étude & more First bold text here. Second one <tag> is here. Ok. Item one. Item two."
    for empty in (None, "", " ", "<", "<p", "<!-- x", "<script>a", "</div>", "<html><body><nav><a>x</a></nav></body></html>"):
        assert html_graph.extract_text(empty) in ("", "<")


def test_marginals_are_exact():
    page, model = html_graph.Page("<body><div class=ad>x</div><article><p>Some text here.</p></article></body>"), html_graph.trained()
    psi = [np.array(model.potential(f)).reshape(3, 3) for f in page.features()]
    n, total, mass = len(page.parent), 0.0, np.zeros((len(page.parent), 3))
    for code in range(3 ** (n - 1)):
        state = [html_graph.FRAME] + [code // 3**k % 3 for k in range(n - 1)]
        p = math.prod(psi[k][state[page.parent[k]], state[k]] for k in range(1, n))
        total += p
        for k in range(n):
            mass[k, state[k]] += p
    assert np.allclose(mass / total, model.marginals(page), atol=1e-6)


def test_held_out_pages():
    wrong = total = 0
    for source in html_graph.labelled_pages(120, seed=41, plain_names="north south k1 k2-x tile slab frame-9"):
        page, state = html_graph.Page(source, labelled=True), []
        for k, label in enumerate(page.label):
            above = state[page.parent[k]] if k else html_graph.FRAME
            state.append(label if label is not None else above if page.text[k] is None or above != html_graph.FRAME else html_graph.BOILERPLATE)
        for k, m in enumerate(html_graph.trained().marginals(page)):
            if page.text[k]:
                total, wrong = total + 1, wrong + ((m[html_graph.CONTENT] > 0.5) != (state[k] == html_graph.CONTENT))
    assert total > 1500 and wrong <= 0.04 * total


def test_layouts_that_training_does_not_make():
    missed = {name for name, (source, text) in layouts.PAGES.items() if html_graph.extract_text(source) != text}
    assert missed <= {"table layout", "misleading names"}
    words = [(Counter(html_graph.extract_text(s).split()), Counter(t.split())) for s, t in layouts.PAGES.values()]
    assert sum((a & b).total() for a, b in words) / sum(max(a.total(), b.total()) for a, b in words) > 0.95


def test_deep_and_unclosed_pages_take_linear_time():
    began = time.process_time()
    article = f"<article><p>{layouts.A}</p><p>{layouts.B}</p></article>"
    assert html_graph.extract_text("<div>" * 12 + article + "</div>" * 12) == f"{layouts.A} {layouts.B}"
    for source in ("<div>" * 50_000 + article + "</div>" * 50_000, "<button>x" * 30_000, "<ul>" + "<div>" * 30_000 + "<li>x" * 30_000, "<p a='" * 20_000, "<" * 50_000, "<a b=" * 30_000, "<p " + "x='" * 50_000):
        html_graph.extract_text(source)
    assert time.process_time() - began < 30


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_graph.extract(pages).collect()}
    assert got == {1: html_graph.extract_text(PAGE), 2: "", None: ""}
    assert html_graph.extract(pages.where("false")).count() == 0


def test_fixture_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in rows.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        import html

        assert html_graph.extract_text(r.html) == " ".join(p for p in (" ".join(html.unescape(x).split()) for x in parts) if p)


# JPEG


@pytest.mark.parametrize("size", [576, 1152, 5760, 40320])
def test_payload_round_trip(size):
    payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    media = pj.encode_payload(payload)
    fast = list(pj.decode_images(media))
    assert b"".join(map(pj.payload_of, fast)) == payload
    if size < 6000:
        for a, b in zip(fast, pj.decode_images(media, plain=False), strict=True):
            assert all((x["coefs"] == y["coefs"]).all() for x, y in zip(a.components, b.components))


def test_several_images(monkeypatch):
    monkeypatch.setattr(pj, "IMAGE_BYTES", 1152)
    payload = bytes(range(256)) * 18
    images = list(pj.decode_images(pj.encode_payload(payload)))
    assert len(images) == 4 and b"".join(map(pj.payload_of, images)) == payload


def code_bits(table, symbol):
    for (length, code), value in table.symbols.items():
        if value == symbol:
            return [code >> k & 1 for k in range(length - 1, -1, -1)]
    raise KeyError(symbol)


def magnitude(v):
    size = abs(v).bit_length()
    return size, [(v if v > 0 else v + (1 << size) - 1) >> k & 1 for k in range(size - 1, -1, -1)]


def progressive(blocks):
    """A grey file of sparse coefficients, written as the format's rules say: DC, DC bit, AC in two bands, AC refinement."""
    counts, symbols = bytes([0] * 7 + [255] + [0] * 8), bytes(range(255))
    table = pj._Huffman(counts, symbols)
    short = lambda v, al: (abs(v) >> al) * (1 if v > 0 else -1)
    head = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([1] * 64)
    for kind in (0x00, 0x10):
        head += b"\xff\xc4" + struct.pack(">HB", 19 + 255, kind) + counts + symbols
    head += b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, 8, 8 * len(blocks), 1) + bytes([1, 0x11, 0])

    def scan(ss, se, ah, al, bits):
        bits = bits + [1] * (-len(bits) % 8)
        return b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, ss, se, ah << 4 | al]) + np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")

    bits, before = [], 0
    for b in blocks:
        size, extra = magnitude((b[0] >> 1) - before)
        bits, before = bits + code_bits(table, size) + extra, b[0] >> 1
    out = head + scan(0, 0, 0, 1, bits) + scan(0, 0, 1, 0, [b[0] & 1 for b in blocks])
    for ss, se in ((1, 5), (6, 63)):
        bits = []
        for b in blocks:
            run = 0
            for k in range(ss, se + 1):
                v = short(b[k], 1)
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + code_bits(table, 0xF0), run - 16
                size, extra = magnitude(v)
                bits, run = bits + code_bits(table, run << 4 | size) + extra, 0
            if run:
                bits += code_bits(table, 0)
        out += scan(ss, se, 0, 1, bits)
    bits = []
    for b in blocks:
        run, held, last = 0, [], max([k for k in range(1, 64) if abs(b[k]) == 1], default=0)
        for k in range(1, 64):
            if k > last:
                held += [abs(b[k]) & 1] if short(b[k], 1) else []
                continue
            if abs(b[k]) == 1:
                bits, run, held = bits + code_bits(table, run << 4 | 1) + [int(b[k] > 0)] + held, 0, []
            elif short(b[k], 1):
                held.append(abs(b[k]) & 1)
            else:
                run += 1
                if run == 16 and k < last:
                    bits, run, held = bits + code_bits(table, 0xF0) + held, 0, []
        bits += (code_bits(table, 0) if last < 63 else []) + held
    return out + scan(1, 63, 1, 0, bits) + b"\xff\xd9"


def test_sparse_scans_and_samples():
    rng = np.random.default_rng(1)
    blocks = rng.integers(-40, 41, (7, 64)) * (rng.random((7, 64)) < 0.2)
    blocks[:, 0] = rng.integers(-300, 300, 7)
    blocks[3, 1:] = 0
    image = next(pj.decode_images(progressive(blocks.tolist())))
    assert (image.components[0]["coefs"] == blocks).all()
    x = np.arange(8)
    plane = np.zeros((8, 56))
    for n, block in enumerate(blocks):
        for k, v in enumerate(block):
            r, c = divmod(int(pj.ZIGZAG[k]), 8)
            scale = (math.sqrt(0.5) if r == 0 else 1) * (math.sqrt(0.5) if c == 0 else 1) / 4
            plane[:, 8 * n : 8 * n + 8] += v * scale * np.outer(np.cos((2 * x + 1) * r * math.pi / 16), np.cos((2 * x + 1) * c * math.pi / 16))
    assert np.abs(image.rgb()[:, :, 0].astype(int) - np.clip(np.round(plane + 128), 0, 255)).max() <= 1


def colour(planes, restart):
    """A file of three components (2x2, 1, 1), all scans plain: DC interleaved, then AC 1-63 of each; restarts after some MCUs."""
    counts, symbols = bytes([0] * 7 + [255] + [0] * 8), bytes(range(255))
    table = pj._Huffman(counts, symbols)
    tall, wide = planes[1].shape[:2]
    out = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes(range(1, 65))
    for kind in (0x00, 0x10):
        out += b"\xff\xc4" + struct.pack(">HB", 19 + 255, kind) + counts + symbols
    out += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    out += b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 16 * tall - 3, 16 * wide - 5, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])

    def scan(parts, names, ss, se):
        body = b""
        for k, bits in enumerate(parts):
            bits = bits + [1] * (-len(bits) % 8)
            body += (b"\xff" + bytes([0xD0 + (k - 1) % 8]) if k else b"") + np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
        return b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(names), len(names)) + b"".join(bytes([c, 0]) for c in names) + bytes([ss, se, 0]) + body

    parts = []
    for n in range(tall * wide):
        if n % restart == 0:
            parts.append([])
            before = [0, 0, 0]
        r, c = divmod(n, wide)
        for i, own in enumerate([[planes[0][2 * r + a, 2 * c + b] for a in (0, 1) for b in (0, 1)], [planes[1][r, c]], [planes[2][r, c]]]):
            for block in own:
                size, extra = magnitude(int(block[0]) - before[i])
                parts[-1] += code_bits(table, size) + extra
                before[i] = int(block[0])
    out += scan(parts, [1, 2, 3], 0, 0)
    for i, plane in enumerate(planes):
        rows = -(-(16 * tall - 3) // 8) if i == 0 else tall
        cols = -(-(16 * wide - 5) // 8) if i == 0 else wide
        parts = []
        for n, block in enumerate(plane[r, c] for r in range(rows) for c in range(cols)):
            if n % restart == 0:
                parts.append([])
            run = 0
            for k in range(1, 64):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    parts[-1], run = parts[-1] + code_bits(table, 0xF0), run - 16
                size, extra = magnitude(int(block[k]))
                parts[-1], run = parts[-1] + code_bits(table, run << 4 | size) + extra, 0
            if run:
                parts[-1] += code_bits(table, 0)
        out += scan(parts, [i + 1], 1, 63)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [2, 5, 100])
def test_colour_with_subsampled_chroma_and_restarts(restart):
    rng = np.random.default_rng(4)
    planes = []
    for rows, cols in ((4, 6), (2, 3), (2, 3)):
        blocks = rng.integers(-9, 10, (rows, cols, 64)) * (rng.random((rows, cols, 64)) < 0.15)
        blocks[..., 0] = rng.integers(-60, 60, (rows, cols))
        planes.append(blocks)
    image = next(pj.decode_images(colour(planes, restart)))
    x, full = np.arange(8), []
    for c, plane in zip(image.components, planes):
        assert (c["coefs"].reshape(plane.shape) == plane).all()
        out = np.zeros((8 * plane.shape[0], 8 * plane.shape[1]))
        for r in range(plane.shape[0]):
            for q in range(plane.shape[1]):
                for k, v in enumerate(plane[r, q]):
                    i, j = divmod(int(pj.ZIGZAG[k]), 8)
                    scale = (math.sqrt(0.5) if i == 0 else 1) * (math.sqrt(0.5) if j == 0 else 1) / 4
                    out[8 * r : 8 * r + 8, 8 * q : 8 * q + 8] += v * (k + 1) * scale * np.outer(np.cos((2 * x + 1) * i * math.pi / 16), np.cos((2 * x + 1) * j * math.pi / 16))
        full.append(np.clip(out + 128, 0, 255))
    y, cb, cr = full[0], *(np.kron(p, np.ones((2, 2))) - 128 for p in full[1:])
    expected = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)[:29, :43]
    assert image.rgb().shape == (29, 43, 3) and np.abs(image.rgb() - expected).max() <= 2.5


def test_other_files_raise():
    good = pj.encode_payload(b"x" * 576)
    for bad in (b"no image", good.replace(b"\xff\xc2", b"\xff\xc0"), good.replace(b"\xff\xc2", b"\xff\xca"), b"\xff\xd8" + good[good.index(b"\xff\xda") :], good[:-2]):
        with pytest.raises(ValueError):
            list(pj.decode_images(bad))


def test_media_column(spark):
    rows = [(1, "Some text"), (2, None), (3, ""), (4, "Some text"), (5, "é" * 30_000), (None, "x"), (None, "x"), (9, "long " * 900_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "media", "n_bytes", "rgb")})
    found = pj.store_and_describe(docs, rounds=3)
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows)
    for name, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[name]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    media = pj.store_texts(docs)
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    assert all(got[k].media_bytes == len(v) and got[k].media_sha256 == hashlib.sha256(v).hexdigest() for k, v in stored.items())
    assert got[1][1:] == got[4][1:]
    for r in pj.rgb_tensors(media).where("doc_id IN (5, 9)").collect():
        images = list(pj.decode_images(stored[r.doc_id]))
        assert [bytes(t) for t in r.rgb] == [i.rgb().tobytes() for i in images] and [len(t) for t in r.rgb] == [3 * h * w for h, w in zip(r.heights, r.widths)]
        means = np.concatenate([i.rgb().reshape(-1, 3) for i in images]).sum(axis=0, dtype=np.int64) * 100 // sum(i.height * i.width for i in images)
        assert got[r.doc_id].feature == "+".join(f"{i.width}x{i.height}" for i in images) + ":" + ",".join(map(str, means))
    assert pj.store_and_describe(docs.where("false"), rounds=2).count() == 0
    empty = pj.features(pj.rgb_tensors(spark.createDataFrame([(1, None), (2, b"")], "doc_id int, media binary"))).collect()
    assert [(r.payload_bytes, r.media_bytes, r.feature) for r in empty] == [(0, 0, ":0,0,0")] * 2


def test_all_labelled_urls_are_counted(spark, monkeypatch):
    """25,000 URLs; the tables' counts are those of all that aren't held aside, and joined tables score as those sent to all tasks."""
    urls = spark.range(25_000).select(F.concat(F.lit("http://h.co/"), "id").alias("url"), (F.col("id") % 2 == 0).alias("accepted"))
    text = um._text(*um.host_and_path(F.col("url")))
    used = urls.where(F.pmod(F.xxhash64(text, F.lit(2)), F.lit(4)) != 0).agg(F.sum(F.length(text))).first()[0]
    model = um.fit(urls)
    assert [t.agg(F.sum(F.col("n_good") + F.col("n_bad"))).first()[0] for t in model.tables] == [used] * um.ORDER
    monkeypatch.setattr(um, "BROADCAST_CONTEXTS", 0)
    pages = urls.limit(300).withColumn("page_id", F.monotonically_increasing_id())
    scores = [{r.page_id: r.score for r in um.judge(pages, m, rules=()).collect()} for m in (model, um.fit(urls))]
    assert scores[0] == pytest.approx(scores[1], rel=1e-9) and len(scores[0]) == 300


# language

WORDS = {"xx": "aber nicht wieder schon immer gegen zwischen", "yy": "pero siempre entre contra nunca ahora", "zz": "toujours jamais contre déjà élève forêt"}


def language_rows(n=120):
    rng = random.Random(6)
    return [(k, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(1, 40))), lang) for k in range(n) for lang in [rng.choice(list(WORDS))]]


def test_language(spark):
    rows = language_rows() + [(900, None, "xx"), (901, "12 34 !!", "xx"), (902, "", None), (903, "ABER NICHT", None), (903, "ÉLÈVE", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("yy") for c in ("id", "score", "lang_pred")})
    model = lb.train(docs.where(~lb.held_out()))
    got = defaultdict(list)
    for r in lb.identify(docs, model).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert all(0 <= s <= 1 for v in got.values() for _, s in v)
    assert [got[k][0][0] for k in (900, 901, 902)] == ["und"] * 3 and sorted(p for p, _ in got[903]) == ["xx", "zz"]
    tested = [(r[2], got[r[0]][0][0]) for r in rows[:120] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(tested) > 20 and all(a == b for a, b in tested)
    flags = dict(map(tuple, docs.where("doc_id < 100").select("doc_id", lb.held_out()).collect()))
    assert flags == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in range(100)}


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "aber", None)], "doc_id long, text string, lang string")
    got = lb.identify(docs, lb.train(docs)).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_false_positives_are_taken_off():
    rng = np.random.default_rng(0)
    masks = (rng.random(1 << 12) < 0.7).astype(np.uint64)  # a filter filled at random
    model = lb.LanguageFilter(["a"], masks)
    raw = np.frombuffer(bytes(rng.integers(97, 123, 60000, dtype=np.uint8)), np.uint8)
    total, clean = model.counts(raw, np.array([0, len(raw)]))
    assert total[0] > 100_000 and clean[0, 0] < 0.05 * total[0]


def folded_grams(text):
    """The n-grams of a text as bytes, from its definition."""
    raw = bytearray()
    for c in text:
        if c.isascii():
            raw += (c.lower() if c.isalpha() else " ").encode()
        else:
            raw += (c.lower() if "À" <= c <= "Þ" and c != "×" else c).encode()
    return [bytes(raw[k : k + n]) for n in lb.SIZES for k in range(len(raw) - n + 1) if raw[k + 1 : k + 2] != b" "]


def test_filter_and_counts_are_those_of_plain_sets(spark):
    """Slots, masks, counts and their correction against sets of n-grams and of slots."""
    rows = [*language_rows(60), (500, "Größe ÉTÉ × 12 ab", "xx"), (501, "x", "yy")]
    model = lb.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), min_docs=1, slot_bits=12)
    names = sorted({r[2] for r in rows})
    assert model.languages == names and model.masks.shape == (1, 1 << 12)

    def slots(gram):
        value = len(gram)
        for byte in gram:
            value = (value << 8 | byte) % 2**64
        h = value * lb._MULTIPLIERS[0] % 2**64
        h ^= h >> 31
        return {(h * m % 2**64) >> (64 - 12) for m in lb._MULTIPLIERS}

    least = {n: min(1, max(1, sum(r[2] == n for r in rows) // 10)) for n in names}
    filters = {n: set().union(*(slots(g) for r in rows if r[2] == n for g in folded_grams(r[1]))) for n in names if least[n] == 1}
    for k, name in enumerate(names):
        assert set(np.flatnonzero(model.masks[0] >> np.uint64(k) & np.uint64(1)).tolist()) == filters[name]
        assert model.rate[k] == pytest.approx((len(filters[name]) / 4096) ** 3)
    texts = [r[1] for r in rows] + ["", "unknown words altogether", "É"]
    joined = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    total, clean = model.counts(np.frombuffer(joined, np.uint8), offsets)
    for j, text in enumerate(texts):
        grams = folded_grams(text)
        assert total[j] == len(grams)
        for k, name in enumerate(names):
            hits = sum(slots(g) <= filters[name] for g in grams)
            assert clean[j, k] == pytest.approx(max(0, hits - len(grams) * model.rate[k]) / (1 - model.rate[k]))


def test_all_labelled_rows_count(spark):
    """4,000 rows: n-grams of rows anywhere among them are learnt, and the threshold is the quantile over all of them."""
    rows = [(k, f"aber nicht {chr(97 + k % 26) * 5}" if k < 3900 else "wieder schon immer gegen", "xx") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lb.train(docs, sample=None)
    whole = spark.createDataFrame([r for r in rows if r[0] < 3900 or r[0] < 3903], "doc_id long, text string, lang string")
    total, hits = model.counts(np.frombuffer(b"wieder schon immer gegen", np.uint8), np.array([0, 24]))
    assert hits[0, 0] > 0.9 * total[0]
    rare = lb.train(whole, sample=None).counts(np.frombuffer(b"wieder schon immer gegen", np.uint8), np.array([0, 24]))  # 3 of 3,903 rows are one in a thousand
    assert rare[1][0, 0] > 0.9 * rare[0][0]
    least = lb.thresholds(docs, model, quantile=0.5, share=1.0)
    cover = [r.coverage for r in lb.identify(docs, model).where("lang_pred = 'xx'").collect()]
    assert least == {"xx": pytest.approx(sorted(cover)[(len(cover) + 1) // 2 - 1])}
    half = docs.where("doc_id % 2 = 0").withColumn("text", F.lit("qqqq wwww nicht aber"))
    mixed = half.unionByName(docs.where("doc_id % 2 = 1"))
    cover = sorted(r.coverage for r in lb.identify(mixed, model).where("lang_pred = 'xx'").collect())
    n = sum(c == cover[0] for c in cover)
    assert n == 2000 and lb.thresholds(mixed, model, quantile=n / len(cover), share=1.0)["xx"] == pytest.approx(cover[0])
    assert lb.thresholds(mixed, model, quantile=(n + 1) / len(cover), share=1.0)["xx"] == pytest.approx(cover[n])


def test_more_languages_than_a_mask_has_bits(spark):
    """130 languages of one word each."""
    word = lambda k: "".join(chr(97 + k // 26**j % 26) * 2 for j in range(4))
    rows = [(100 * k + j, " ".join([word(37 * k + 11)] * 5), f"l{k:03}") for k in range(130) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lb.train(docs)
    assert model.masks.shape[0] == 3 and len(model.languages) == 130
    assert all(r.lang_pred == r.lang for r in lb.identify(docs, model, keep=("lang",)).collect())


# URLs


def brute_score(labelled, text):
    """The smoothed models by recursion."""
    counts = {True: Counter(), False: Counter()}
    for own, good in labelled:
        padded = um.PAD * um.ORDER + own
        for k in range(um.ORDER, len(padded)):
            for n in range(1, um.ORDER + 1):
                counts[good][padded[k - n : k], padded[k]] += 1

    def probability(good, context, c):
        if not context:
            return 1 / um.ALPHABET
        seen = [v for (x, _), v in counts[good].items() if x == context]
        lower = probability(good, context[1:], c)
        return (counts[good][context, c] + len(seen) * lower) / (sum(seen) + len(seen)) if seen else lower

    padded = um.PAD * um.ORDER + text
    parts = [math.log(probability(False, padded[k - um.ORDER : k], padded[k]) / probability(True, padded[k - um.ORDER : k], padded[k])) for k in range(um.ORDER, len(padded))]
    return sum(parts) / len(parts)


def test_url_scores(spark):
    urls = [(f"http://{'casino' if k % 2 else 'garden'}{k}.com/p{k}", k % 2 == 0) for k in range(24)]
    model = um.fit(spark.createDataFrame(urls, "url string, accepted boolean"))
    host, path = um.host_and_path(F.col("url"))
    seen = spark.createDataFrame(urls, "url string, accepted boolean").select(um._text(host, path).alias("text"), "accepted").where(F.pmod(F.xxhash64("text", F.lit(2)), F.lit(4)) != 0)
    labelled = [(r.text, r.accepted) for r in seen.collect()]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(["http://casino.com/x", "https://garden.org", "ftp://ünï.de/ß?q"])], "page_id long, url string")
    for r in um.judge(pages, model, rules=()).collect():
        assert r.score == pytest.approx(brute_score(labelled, r.host + r.path), rel=1e-9)
        assert r.verdict == ("block" if r.score > model.threshold else "allow")


def test_url_rules(spark):
    urls = {
        "http://WWW.Foo.NET/a?x#y": ("www.foo.net", "/a", "net/", "block"), "https://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"), "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/z": ("x.org", "/fr/z", "org/fr/", "allow"), "http://foo.net": ("foo.net", "", None, None), "http://notexample.com/de/1": ("notexample.com", "/de/1", None, None), "//foo.net/": ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://internet/": ("internet", "/", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "x://h?/net/": ("h", "", None, None), "http://": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(98, None), (None, "http://a.net/"), (5, "http://x.org/fr/z")], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "text", "score")})
    model = um.fit(um.labelled_by_rules(spark.createDataFrame([(f"http://x{k}.{e}",) for k in range(60) for e in ("net/a", "org/fr/b")], "url string")))
    got = um.judge(pages, model).collect()
    assert len(got) == len(urls) + 3
    by = {r.page_id: r for r in got if r.page_id not in (5, None)}
    for k, (host, path, rule, verdict) in enumerate(urls.values()):
        if k in by:
            assert (by[k].host, by[k].path, by[k].rule) == (host, path, rule)
            assert verdict is None or by[k].verdict == verdict
    assert (by[98].host, by[98].path, by[98].rule, by[98].verdict) == ("", "", None, "allow")
    assert um.judge(pages.where("false"), model).count() == 0


def rule_rows(spark, seed, n):
    """URLs of shops under several endings, of which some rules decide a part: /offer/ is what rejected ones share."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice(["ka", "lo", "mi", "su", "re", "tan"]) for _ in range(rng.randint(2, 4)))
    rows = []
    for k in range(n):
        bad = k % 2 == 0
        path = f"/offer/{rng.randint(1, 99)}?win" if bad else f"/{rng.choice(['about', 'read', 'learn'])}/{name()}"
        rows.append((k, f"http://{name()}.{rng.choice(['xx', 'com']) if bad else rng.choice(['yy', 'com'])}{path}", not bad))
    return spark.createDataFrame(rows, "page_id long, url string, accepted boolean")


def test_rules_teach_the_models(spark):
    """The rules decide hosts under xx and yy; what the models learn there holds for com."""
    rules, rows = (("xx", "/", "block"), ("yy", "/", "allow")), rule_rows(spark, 1, 3000)
    labelled = um.labelled_by_rules(rows, rules=rules)
    assert {r.accepted for r in labelled.where("url LIKE '%.yy/%'").collect()} == {True} and labelled.where("url LIKE '%.com/%'").count() == 0
    judged = um.judge(rows, um.fit(labelled), rules=rules).join(rows.select("page_id", "accepted"), "page_id")
    rest = judged.where("rule IS NULL")
    assert rest.count() > 1000
    assert rest.agg(F.avg(((F.col("verdict") == "allow") == F.col("accepted")).cast("double"))).first()[0] > 0.95


def test_long_repeated_and_unlearned_urls(spark):
    model = um.fit(um.labelled_by_rules(rule_rows(spark, 2, 400), rules=(("xx", "/", "block"), ("yy", "/", "allow"))))
    long = "http://a.com/" + "offer/" * 30_000
    pages = spark.createDataFrame([(1, long), (2, long + "x"), *((3, "http://b.com/read/kalo"),) * 50], "page_id long, url string")
    got = um.judge(pages, model, rules=()).collect()
    assert len(got) == 52 and len({r.score for r in got if r.page_id == 3}) == 1 and abs(got[0].score) < 20
    nothing = um.fit(rule_rows(spark, 3, 10).select("url", "accepted").where("accepted"))
    assert {r.verdict for r in um.judge(pages, nothing, rules=()).collect()} == {"allow"}


# pipeline


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(corpus_pipeline.COLUMNS)
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert sizes[0] == sizes[1] > sizes[2] > sizes[3] > 0.8 * sizes[0]
    mixed = corpus_pipeline.materialize(corpus_pipeline.source_mixing(spark, docs, folder), "stage")
    words = lambda df: sum(len(r.text.split()) for r in df.select("text").collect())
    assert words(mixed) == pytest.approx(1.5 * words(docs), rel=0.01)
    out = corpus_pipeline.token_id_output(spark, mixed, folder)
    assert out.count() == mixed.count()
    assert corpus_pipeline.run(spark, folder).count() == mixed.count()


def test_pipeline_rejects_unlearned_languages(spark):
    import corpus_pipeline

    rows = language_rows(300) + [(1000, "questa mattina siamo andati al mercato per comprare frutta fresca", None), (1001, "vanochtend zijn we naar de markt gegaan om vers fruit te kopen", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == set(range(300))
