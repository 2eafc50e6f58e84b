"""Benchmark decontamination by a prefix-filtered set join.

Every run of ``window`` words of a benchmark item (the whole item where it is
shorter) is a window; its set is its word shingles with their positions.  The
shingles are ordered by rarity, counted over all documents.  A document that
contains the window contains all its shingles, so for a containment of 1 the
necessary prefix is the window's rarest shingle alone: only where a document
has that shingle is the window tried, at the one start that the shingle's
position leaves, if the document has enough words on both sides (the length
and positional bounds).  Exact containment of the whole window is verified last.

The benchmark is the small side.  It is sent to the workers in blocks of at
most ``max_windows`` windows (about 60 bytes each); a larger benchmark takes
more passes over the documents, each with one block, and the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .textbytes import ALNUM, LOWER, blocks, expand, hash_spans, text_buffer, window_hashes, word_spans
from .workspace import materialize

SHINGLE = 3
_FILTER_BITS = 20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block of texts, and each text's first word (with the end)."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM)
    return hash_spans(data, starts, ends), first


def _windows(window: int, shingle: int):
    """(item, hash, length, width, shingles): the windows of the benchmark items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            data, offsets = text_buffer(batch.column(1))
            words, first = _words(data, offsets)
            for item, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                size = min(window, b - a)
                if not size:
                    continue
                width = min(shingle, size)
                whole, parts = window_hashes(words[a:b], size).view(np.int64), window_hashes(words[a:b], width).view(np.int64)
                out += [(item, int(h), size, width, parts[k : k + size - width + 1].tolist()) for k, h in enumerate(whole)]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["item", "hash", "size", "width", "parts"])

    return run


class _Finder:
    """Membership of many hashes in a sorted set, behind a bit filter."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[keys >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a key of the set occurs, and which key it is."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[k] == hashes[at]
        return at[hit], k[hit]


def _frequencies(shared):
    """(part, n): occurrences of the benchmark's shingles in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {w: _Finder(k) for w, k in shared.value.items()}
        counts = {w: np.zeros(len(f.keys), dtype=np.int64) for w, f in finders.items()}
        for batch in batches:
            for _, _, part, at in blocks(*text_buffer(batch.column(0))):
                words, _ = _words(part, at)
                for w, finder in finders.items():
                    counts[w] += np.bincount(finder.find(window_hashes(words, w))[1], minlength=len(finder.keys))
        for w, n in counts.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(finders[w].keys[seen].view(np.int64)), pa.array(n[seen])], names=["part", "n"])

    return run


class _Block:
    """One block of windows, grouped by the width of its shingles and their rarest shingle."""

    def __init__(self, rows: list):
        self.items = sorted({i for r in rows for i in r.items})
        place = {i: k for k, i in enumerate(self.items)}
        self.groups = []
        for width in sorted({r.width for r in rows}):
            own = sorted((r for r in rows if r.width == width), key=lambda r: r.part & (2**64 - 1))
            part = np.array([r.part for r in own], dtype=np.int64).view(np.uint64)
            keys, begin = np.unique(part, return_index=True)
            names = [[place[i] for i in r.items] for r in own]
            self.groups.append({
                "width": width, "keys": keys, "begin": np.append(begin, len(own)),
                "shift": np.array([r.shift for r in own], dtype=np.int64), "size": np.array([r.size for r in own], dtype=np.int64),
                "hash": np.array([r.hash for r in own], dtype=np.int64).view(np.uint64),
                "names": np.array([n for each in names for n in each], dtype=np.int64), "named": np.concatenate(([0], np.cumsum([len(n) for n in names]))),
            })


def _probe(shared):
    """(key columns, n_words, begins, ends, items) per text; word spans are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        finders = [_Finder(g["keys"]) for g in block.groups]
        for batch in batches:
            numbers, begins, ends, items = [], [], [], []
            for _, _, part, at in blocks(*text_buffer(batch.column(1))):
                words, first = _words(part, at)
                numbers.append(np.diff(first))
                delta, pairs = np.zeros(len(words) + 1, dtype=np.int64), []
                for g, finder in zip(block.groups, finders):
                    where, k = finder.find(window_hashes(words, g["width"]))
                    if not len(where):
                        continue
                    n = g["begin"][k + 1] - g["begin"][k]
                    w = expand(g["begin"][k], n)
                    start = np.repeat(where, n) - g["shift"][w]
                    doc = np.searchsorted(first, np.repeat(where, n), side="right") - 1
                    fits = (start >= first[doc]) & (start + g["size"][w] <= first[doc + 1])
                    w, start, doc = w[fits], start[fits], doc[fits]
                    for size in np.unique(g["size"][w]).tolist():
                        own = g["size"][w] == size
                        same = window_hashes(words, size)[start[own]] == g["hash"][w[own]]
                        s, d, v = start[own][same], doc[own][same], w[own][same]
                        np.add.at(delta, s, 1)
                        np.add.at(delta, s + size, -1)
                        n = g["named"][v + 1] - g["named"][v]
                        pairs.append(np.stack([np.repeat(d, n), g["names"][expand(g["named"][v], n)]]))
                inside = np.cumsum(delta[:-1]) > 0
                # a span ends with its text: two hits that touch across a border stay apart
                new = np.zeros(len(words) + 1, dtype=bool)
                new[first] = True
                prev, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
                lead = np.flatnonzero(inside & (~prev | new[:-1]))
                last = np.flatnonzero(inside & (~after | new[1:])) + 1
                doc = np.searchsorted(first, lead, side="right") - 1
                edge = np.searchsorted(doc, np.arange(1, len(first) - 1))
                begins += np.split(lead - first[doc], edge)
                ends += np.split(last - first[doc], edge)
                found = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
                names = np.split(found[1], np.searchsorted(found[0], np.arange(1, len(first) - 1)))
                items += [[block.items[k] for k in row] for row in names]
            n_words = pa.array(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), pa.int64())
            spans = [pa.array([x.tolist() for x in side], pa.list_(pa.int64())) for side in (begins, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, *spans, pa.array(items, pa.list_(pa.string()))], names=["key", "n_words", "begins", "ends", "items"])

    return run


_FOUND = "n_words bigint, begins array<bigint>, ends array<bigint>, items array<string>"


def _blocks_of(spark: SparkSession, windows: DataFrame, texts: DataFrame, many: int) -> Iterator:
    """Broadcast blocks of windows, each window with its rarest shingle, one after the other."""
    for k in range(many):
        own = windows.where(F.pmod("hash", F.lit(many)) == k)
        parts = own.select("width", F.explode("parts").alias("part")).distinct()
        keys: dict[int, list] = {}
        for row in parts.collect():  # at most max_windows windows of max_windows shingles in all
            keys.setdefault(row.width, []).append(row.part)
        shared = spark.sparkContext.broadcast({w: np.sort(np.array(v, dtype=np.int64).view(np.uint64)) for w, v in keys.items()})
        seen = texts.select("text").mapInArrow(_frequencies(shared), "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
        each = own.select("hash", "size", "width", "items", F.posexplode("parts").alias("shift", "part")).join(F.broadcast(seen), "part", "left")
        rarest = each.groupBy("hash", "size", "width").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part", "shift")).alias("r"), F.first("items").alias("items")
        )
        rows = rarest.select("hash", "size", "width", "items", "r.part", "r.shift").collect()
        yield spark.sparkContext.broadcast(_Block(rows))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 10, shingle: int = SHINGLE, max_windows: int = 1_000_000,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items, spans.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
    items: the sorted ids (strings) of the items with a window in the document.
    spans: merged word ranges (begin, end) inside window occurrences; n_hit is
    the number of words in them.  Words, shingles and windows are compared by
    64-bit hashes: of n document words and m windows, n * m / 2 ** 64 are
    expected to be taken for equal wrongly (5e-4 for 1e10 words and 1e6
    windows).  Null and empty texts have no words and no
    windows; items with a null id are left out; repeated items and documents
    are treated alike, each row by itself.  With an empty benchmark nothing is
    hit.  Other columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    made = items.mapInArrow(_windows(window, shingle), "item string, hash bigint, size int, width int, parts array<bigint>")
    made = made.groupBy("hash", "size", "width").agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("parts").alias("parts"))
    windows = materialize(made, "windows")
    many = max(1, -(-windows.count() // max_windows))
    shared = _blocks_of(spark, windows, rows, many)
    kind = dict(rows.dtypes)["key"]
    if many == 1:
        found = rows.mapInArrow(_probe(next(shared)), f"key {kind}, {_FOUND}")
    else:
        digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
        texts = rows.select(digest.alias("key"), "text")
        passes = []
        for block in shared:  # a pass is stored before the next block is made, so that one block at a time is held
            passes.append(materialize(texts.mapInArrow(_probe(block), f"key binary, {_FOUND}").where("size(items) > 0 OR n_words > 0").distinct(), "passes"))
            block.unpersist()
        merged = passes[0]
        for one in passes[1:]:
            merged = merged.unionByName(one)
        merged = merged.groupBy("key").applyInArrow(_merge, f"key binary, {_FOUND}")
        found = rows.select("key", digest.alias("digest")).join(merged.withColumnRenamed("key", "digest"), "digest", "left")
        empty = {"begins": "array<bigint>", "ends": "array<bigint>", "items": "array<string>"}
        found = found.select("key", F.coalesce("n_words", F.lit(0)).alias("n_words"), *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in empty.items()])
    hit = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return found.select(F.col("key").alias(id_col), "n_words", hit.alias("n_hit"), "items", F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end")).alias("spans"))


def _merge(group: pa.Table) -> pa.Table:
    """The spans and items of one text from several blocks."""
    spans = sorted((b, e) for bs, es in zip(group["begins"].to_pylist(), group["ends"].to_pylist()) for b, e in zip(bs, es))
    out: list[list[int]] = []
    for b, e in spans:
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    items = sorted({i for row in group["items"].to_pylist() for i in row})
    return pa.table({
        "key": group["key"].slice(0, 1), "n_words": group["n_words"].slice(0, 1), "begins": pa.array([[b for b, _ in out]], pa.list_(pa.int64())),
        "ends": pa.array([[e for _, e in out]], pa.list_(pa.int64())), "items": pa.array([items], pa.list_(pa.string())),
    })


def items_digest(items: list[str]) -> str:
    """What the query's items_sha256 holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
