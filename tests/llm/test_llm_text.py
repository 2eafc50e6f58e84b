"""Token counts, token-id shards and the byte utilities, against the library and plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.llm import bitplanes, textbytes, token_counts, tokenizer_files, tokenizing

BYTE, WORD = tokenizer_files.path("byte_bpe_50k.json"), tokenizer_files.path("word_bpe_49k.json")
MARKS = list("abzAZ019 .,'!|<>-\n\n\t\r  ") + ["'s", "'LL", "é", "É", "İ", "ß", "Σ", "ς", "́", " ", " ", "’", "中", "🙂", "×", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\x00", "½", "ﬁ", "don't", "　"]


def texts(seed: int, n: int = 1500) -> list[str]:
    rng = random.Random(seed)
    return ["", " ", "\n", *("".join(rng.choice(MARKS) for _ in range(rng.randint(0, 40))) for _ in range(n))]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_give_the_librarys_ids(path):
    own, given_ = tokenizing.encoder(path), texts(3)
    data, offsets = textbytes.text_buffer(pa.array([None, *given_]))
    ids, counts = own.ids(data, offsets)
    expected = own.encode(["", *given_])
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == expected
    assert own.counts(data, offsets).tolist() == [len(x) for x in expected]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_any_text(values):
    data, offsets = textbytes.text_buffer(pa.array(values, pa.string()))
    for path in (BYTE, WORD):
        own = tokenizing.encoder(path)
        assert own.counts(data, offsets).tolist() == [len(x) for x in own.encode(values)]


def test_hashes_do_not_depend_on_the_place():
    word = "größe".encode()
    data = np.frombuffer(b"x" * (1 << 20) + b" " + word + b" y " + word, np.uint8)
    at = np.array([(1 << 20) + 1, len(data) - len(word)])
    a, b = textbytes.hash_spans(data, at, at + len(word))
    alone = textbytes.hash_spans(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]
    assert a == b == alone


def test_slices_and_long_texts():
    column = pa.array(["aa", None, "b c" * 2_000_000, "d"]).slice(1)
    data, offsets = textbytes.text_buffer(column)
    assert offsets.tolist() == [0, 0, 6_000_000, 6_000_001]
    assert [(a, b) for a, b, _, _ in textbytes.blocks(data, offsets)] == [(0, 1), (1, 2), (2, 3)]


ROWS = [(1, "Hello there, world."), (2, None), (3, ""), (4, "Hello there, world."), (None, "x"), (5, "word " * 600), (5, "twice")]


def documents(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.withColumns({c: F.lit(1) for c in ("id", "digest", "n_tokens", "part", "key")})


def test_counts_and_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    got = token_counts.count_tokens(documents(spark), BYTE, cache=cache)
    library = tokenizing.encoder(BYTE).encode([t or "" for _, t in ROWS])
    expected = [(d, len((t or "").encode()), len(x), len(x) > 512) for (d, t), x in zip(ROWS, library)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    stored = spark.read.parquet(cache)
    assert stored.count() == 5  # distinct contents
    spark.createDataFrame([(hashlib.sha256(b"fresh").digest(), tokenizing.file_digest(BYTE), 99)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    again = token_counts.count_tokens(spark.createDataFrame([(1, "fresh"), (2, "newer")], "doc_id long, text string"), BYTE, cache=cache)
    assert {r.doc_id: r.n_tokens for r in again.collect()} == {1: 99, 2: len(tokenizing.encoder(BYTE).encode(["newer"])[0])}
    assert spark.read.parquet(cache).count() == 7
    assert token_counts.count_tokens(documents(spark).where("false"), BYTE).count() == 0


def test_a_warm_run_encodes_and_shuffles_no_text(spark, tmp_path, monkeypatch):
    cache, path = str(tmp_path / "cache"), str(tmp_path / "documents")
    spark.createDataFrame([(k, f"text {k % 7} " * (1 + k % 5)) for k in range(100)], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    cold = sorted(map(tuple, token_counts.count_tokens(docs, BYTE, cache=cache).collect()))
    files = sorted(tmp_path.glob("cache/part-*"))
    monkeypatch.setattr(token_counts, "_count", None)  # nothing is left to encode
    warm = token_counts.count_tokens(docs, BYTE, cache=cache)
    assert sorted(map(tuple, warm.collect())) == cold and sorted(tmp_path.glob("cache/part-*")) == files
    plan = warm._jdf.queryExecution().optimizedPlan().toString()
    assert all("text" not in line for line in plan.splitlines() if "Join" in line or "Aggregate" in line)
    assert re.search(r"Project \[doc_id#\d+L AS id#\d+L, cast\(octet_length", plan)  # below the join, texts are lengths and digests


def test_partly_warm_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "SLOTS", 2)  # a full filter lets all texts through
    cache = str(tmp_path / "cache")
    token_counts.count_tokens(documents(spark).where("doc_id < 4"), BYTE, cache=cache)
    got = token_counts.count_tokens(documents(spark), BYTE, cache=cache)
    library = tokenizing.encoder(BYTE).encode([t or "" for _, t in ROWS])
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect()) == sorted((d or 0, len(x)) for (d, _), x in zip(ROWS, library))
    assert spark.read.parquet(cache).count() == 5


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=6), st.sampled_from([1, 8]), st.integers(1, 20))
def test_shard_round_trip(docs, kind, block):
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    ids = np.array([x for d in docs for x in d], dtype="<u4")
    file = bitplanes.encode_shard(bitplanes.Shard(3, 4, 5, np.arange(len(docs)), lengths, ids), kind, block)
    got = bitplanes.decode_shard(file)
    assert (got.part, got.seq, got.before) == (3, 4, 5)
    assert got.doc_ids.tolist() == list(range(len(docs))) and got.lengths.tolist() == lengths.tolist() and got.ids.tolist() == ids.tolist()
    for bad in (b"none" + file[4:], file[:-1], file[:-1] + b" "):
        with pytest.raises(ValueError):
            bitplanes.decode_shard(bad)


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_shards_of_documents(spark, tmp_path, planes, monkeypatch):
    folder = bitplanes.write_shards(documents(spark), WORD, 2, folder=str(tmp_path / "shards"), planes=planes)
    got = sorted(map(tuple, bitplanes.read_documents(spark, folder).collect()), key=lambda r: r[1])
    tie = {r.text: r.h for r in documents(spark).select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]], r[1] or ""))
    at, expected, every = 0, [], []
    for (name, _), ids in zip(rows, tokenizing.encoder(WORD).encode([t or "" for _, t in rows])):
        own = np.array([*ids, 2], dtype="<u4")
        expected.append((name, at, len(own), zlib.crc32(own.tobytes())))
        at, every = at + len(own), [*every, *own.tolist()]
    assert got == expected
    assert [x for part in bitplanes.read_ids(spark, folder) for x in part.tolist()] == every
    files = [f.read_bytes() for f in (tmp_path / "shards").glob("part-*")]
    assert sum(len(bitplanes.decode_shard(f).ids) for f in files if f) == len(every)
    assert bitplanes.read_documents(spark, bitplanes.write_shards(documents(spark).where("false"), WORD, 2)).count() == 0


def test_shards_in_several_files(spark, tmp_path):
    """Any bytes come back from the text writer, one file for each shard."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, "".join(rng.choice(MARKS) for _ in range(200))) for k in range(300)], "doc_id long, text string").repartition(3)
    folder = bitplanes.write_shards(docs, WORD, 2, folder=str(tmp_path / "shards"), partitions=2)
    got = bitplanes.read_documents(spark, folder).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(300)) and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHE_BITS", 3)
    own, given_ = tokenizing.UnitEncoder(WORD), [*texts(8, 300), "x" * 5000 + "'" + "y" * 5000]
    for _ in range(3):
        for k in range(0, len(given_), 20):
            data, offsets = textbytes.text_buffer(pa.array(given_[k : k + 20]))
            ids, counts = own.ids(data, offsets)
            assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == own.encode(given_[k : k + 20])
            assert own.counts(data, offsets).tolist() == counts.tolist()
