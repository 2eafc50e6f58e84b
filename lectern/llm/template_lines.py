"""Line dedup by a fixed-depth tree of log templates.

A line goes down the tree by its number of tokens and its first ``depth``
tokens, tokens with a digit being variable at once.  In a leaf, a line joins
the template that it shares most tokens with, if they are at least
``similarity`` of its tokens, and positions at which they differ become
variable fields; else it starts a template.  A field is variable as soon as
two values are seen, so that more rows never make its values constant: lines
that share ``similarity`` of their tokens with all of each other end in one
template at any size, if nothing else is in their leaf.  A line with fewer
tokens without a digit than that has no template.  The lines of templates that
recur across documents are dropped.

Lines of PASSAGE_WORDS tokens or more are also cut into segments, so that a
passage is found wherever it stands: at the ends of sentences and, in
sentences of more than LONG_SENTENCE tokens, after tokens whose hash is the
least of its neighbours' and after every CUT_REACH equal tokens.  A segment recurs if it is found in several
documents with equal tokens, those with a digit being variable.  Where
successive segments recur and have PASSAGE_WORDS tokens together, they go from
a line that stays.

Tokens are runs of ``[^\\x20\\x09-\\x0D]``.  Lines and segments are told apart
by 128-bit digests, made for whole blocks of texts at once; only lines of
leaves that several documents reach are ever taken apart into strings, each
distinct one once for a block.  A leaf of many lines is dealt, by digest, to
groups; the groups' templates then meet in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .textbytes import NOT_SPACE, blocks, hash_runs, hash_spans, mix, text_buffer, word_spans
from .workspace import materialize

DEPTH, SIMILARITY = 3, 0.5
VARIABLE = "<*>"
#: Size of the filters of leaves and segments that several documents reach: 2 ** 26 bits are 8 MB.
FILTER_BITS = 26
#: Lines and tokens of a leaf, copies counted, for each group in which its lines meet first.
CHUNK_LINES, CHUNK_TOKENS = 8192, 1 << 21
#: Tokens of successive recurring segments that make a passage.
PASSAGE_WORDS = 24
#: Longer sentences are cut after tokens with the least hash of CUT_REACH tokens on either side.
LONG_SENTENCE, CUT_REACH = 20, 8
#: Signs that may follow the end of a sentence: at most so many are looked through.
CLOSERS = 4
_U64 = np.uint64
_VARIABLE_HASH = _U64(0x5DEECE66D1234567)
_IS_DIGIT = np.zeros(256, dtype=bool)
_IS_DIGIT[48:58] = True
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


class _Lines:
    """The lines of a block of texts: places of tokens and lines, and hashes of the tokens that are asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, first = word_spans(data, offsets, NOT_SPACE)
        n = len(self.starts)
        self.digit = np.zeros(n, dtype=bool)
        self.digit[np.searchsorted(self.starts, np.flatnonzero(_IS_DIGIT[data]), side="right") - 1] = True
        feeds = np.flatnonzero(data == 10)
        # a line begins with the first token of a text, and with the first one after a line feed
        self.first = np.unique(np.concatenate((first[:-1][np.diff(first) > 0], np.searchsorted(self.starts, feeds))))
        self.first = self.first[self.first < n]
        self.end = np.append(self.first[1:], n)[: len(self.first)]
        self.size = self.end - self.first
        self.doc = np.searchsorted(first, self.first, side="right") - 1
        self.line = np.searchsorted(feeds, self.starts[self.first]) - np.searchsorted(feeds, offsets[self.doc])

    def hashes(self, tokens: np.ndarray) -> np.ndarray:
        """Hashes of some of the tokens; those with a digit have one hash for all."""
        size = self.ends[tokens] - self.starts[tokens]
        edge = np.concatenate(([0], np.cumsum(size)))
        own = self.data[np.arange(edge[-1]) + np.repeat(self.starts[tokens] - edge[:-1], size)]
        words = hash_spans(own, edge[:-1], edge[1:])
        words[self.digit[tokens]] = _VARIABLE_HASH
        return words

    def leaves(self, depth: int) -> np.ndarray:
        """Each line's leaf: by its number of tokens and its first tokens."""
        n = np.minimum(self.size, depth)
        edge = np.concatenate(([0], np.cumsum(n)))
        words = self.hashes(np.arange(edge[-1]) + np.repeat(self.first - edge[:-1], n))
        return mix(hash_runs(words, edge[:-1], edge[1:]) + self.size.astype(np.uint64) * _U64(0xD1B54A32D192ED03))


def _digests(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of runs of tokens."""
    return hash_runs(words, starts, ends), hash_runs(mix(words + _U64(0x9E3779B97F4A7C15)), starts, ends)


class _Block(_Lines):
    """All tokens' hashes, the lines' digests, and the segments."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets)
        self.words = hash_spans(data, self.starts, self.ends)
        self.words[self.digit] = _VARIABLE_HASH
        self.digest = _digests(self.words, self.first, self.end)

    def hashes(self, tokens: np.ndarray) -> np.ndarray:
        return self.words[tokens]

    def enough(self, similarity: float) -> np.ndarray:
        """Which lines have tokens enough for a template."""
        plain = np.concatenate(([0], np.cumsum(~self.digit)))
        return plain[self.end] - plain[self.first] >= similarity * self.size

    def _sentence_ends(self) -> np.ndarray:
        """Which tokens end with one of .!?… and at most CLOSERS closing signs."""
        data, out, at = self.data, np.zeros(len(self.ends), dtype=bool), self.ends.copy()
        left = np.arange(len(at))
        for _ in range(CLOSERS + 1):
            end = at[left]
            room = end - self.starts[left]
            last = data[end - 1]
            two = np.where(room > 1, data[np.maximum(end - 2, 0)], 0)
            three = np.where(room > 2, data[np.maximum(end - 3, 0)], 0)
            stop = (last == 46) | (last == 33) | (last == 63) | ((three == 0xE2) & (two == 0x80) & (last == 0xA6))
            out[left[stop]] = True
            width = np.where((last == 34) | (last == 39) | (last == 41) | (last == 93) | (last == 125), 1, 0)
            width[(two == 0xC2) & (last == 0xBB)] = 2
            width[(three == 0xE2) & (two == 0x80) & ((last == 0x9D) | (last == 0x99))] = 3
            go = ~stop & (width > 0) & (room > width)
            at[left[go]] -= width[go]
            left = left[go]
            if not len(left):
                break
        return out

    def segments(self, passage_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lines of the segments, and the segments' first and end tokens."""
        n = len(self.starts)
        cut = self._sentence_ends()
        cut[self.end - 1] = True
        edge = np.flatnonzero(cut)
        long = np.repeat(np.diff(np.concatenate(([-1], edge))) > LONG_SENTENCE, np.diff(np.concatenate(([-1], edge))))
        if long.any():
            line = np.repeat(np.arange(len(self.first)), self.size)
            least = long.copy()
            for d in range(1, min(CUT_REACH, n - 1) + 1):
                same = line[d:] == line[:-d]
                least[:-d] &= ~same | (self.words[:-d] <= self.words[d:])
                least[d:] &= ~same | (self.words[d:] < self.words[:-d])
            alike = np.zeros(n, dtype=bool)
            alike[1:] = (self.words[1:] == self.words[:-1]) & (line[1:] == line[:-1])
            start = np.flatnonzero(~alike)
            place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
            edge = np.flatnonzero(cut | least | (long & (place % CUT_REACH == CUT_REACH - 1)))
        begin, end = np.concatenate(([0], edge[:-1] + 1)), edge + 1
        own = np.searchsorted(self.first, begin, side="right") - 1
        keep = self.size[own] >= passage_words
        return own[keep], begin[keep], end[keep]


_UNITS = "id bigint, line int, part int, first int, n int, row bigint, leaf bigint, a bigint, b bigint"


def _longs(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64(), mask=mask)


def _units(depth: int, similarity: float, passage_words: int):
    """A row for each line that isn't blank (part 0) and each segment of a longer one (part from 1).

    id, line (its number from 0), part, first (its first token), n, row (a
    digest of the line), leaf (null without a template or for a segment), a, b
    (its own digest).
    """

    names, types = _UNITS.replace(",", "").split()[::2], [pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 4]

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        columns = [pa.concat_arrays(c) for c in zip(*parts)] if parts else [pa.array([], t) for t in types]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = lambda x: pa.array(x.astype(np.int32))
        for batch in batches:
            ids, lines, segments = batch.column(0), [], []
            for start, _, data, at in blocks(*text_buffer(batch.column(1))):
                block = _Block(data, at)
                if not len(block.first):
                    continue
                zero, digest = np.zeros(len(block.first), dtype=np.int64), block.digest
                leaf = _longs(block.leaves(depth), ~block.enough(similarity))
                lines.append((ids.take(pa.array(start + block.doc)), ints(block.line), ints(zero), ints(zero), ints(block.size), _longs(digest[0]), leaf, _longs(digest[0]), _longs(digest[1])))
                own, begin, end = block.segments(passage_words)
                if len(own):
                    change = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    part = np.arange(len(own)) - np.repeat(change, np.diff(np.append(change, len(own)))) + 1
                    a, b = _digests(block.words, begin, end)
                    none = pa.nulls(len(own), pa.int64())
                    segments.append((ids.take(pa.array(start + block.doc[own])), ints(block.line[own]), ints(part), ints(begin - block.first[own]), ints(end - begin), _longs(digest[0][own]), none, _longs(a), _longs(b)))
            # lines and segments apart, so that a scan of either skips the other's pages
            yield batch_of(lines)
            yield batch_of(segments)

    return run


def _known(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the filter."""
    slot = values & _U64(8 * len(bits) - 1)
    return (bits[(slot >> _U64(3)).astype(np.int64)] >> (slot & _U64(7)).astype(np.uint8) & 1).astype(bool)


def _candidates(depth: int, similarity: float, shared):
    """(leaf, a, b, n, tokens) of the lines whose leaves are in the filter, each distinct line once for a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for _, _, data, at in blocks(*text_buffer(batch.column(1))):
                block = _Lines(data, at)
                leaf = block.leaves(depth)
                hit = np.flatnonzero(_known(bits, leaf))
                size = block.size[hit]
                edge = np.concatenate(([0], np.cumsum(size)))
                tokens_of = np.arange(edge[-1]) + np.repeat(block.first[hit] - edge[:-1], size)
                words, digit = block.hashes(tokens_of), block.digit[tokens_of]
                plain = np.concatenate(([0], np.cumsum(~digit)))
                a, b = _digests(words, edge[:-1], edge[1:])
                own = np.flatnonzero(plain[edge[1:]] - plain[edge[:-1]] >= similarity * size)
                own = own[np.unique(a[own], return_index=True)[1]]
                tokens = []
                for k, line in zip(own.tolist(), hit[own].tolist()):
                    raw = data[block.starts[block.first[line]] : block.ends[block.end[line] - 1]].tobytes().split()
                    for j in np.flatnonzero(digit[edge[k] : edge[k + 1]]).tolist():
                        raw[j] = VARIABLE.encode()
                    tokens.append(b" ".join(raw).decode())
                columns = [_longs(leaf[hit[own]]), _longs(a[own]), _longs(b[own]), pa.array(size[own].astype(np.int32)), pa.array(tokens, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["leaf", "a", "b", "n", "tokens"])

    return run


def _filter_of(values: DataFrame, column: str):
    """The values as a broadcast filter of 2 ** FILTER_BITS bits, whatever their number.

    A full filter lets more rows through, which the exact joins drop.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = values.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("m")).toArrow()
    table = np.zeros(1 << max(0, FILTER_BITS - 6), dtype="<u8")
    table[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return values.sparkSession.sparkContext.broadcast(table.tobytes())


def _runs(passage_words: int, shared):
    """The segments in the filter that stand in runs of ``passage_words`` tokens, or at a batch's edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            known = _known(bits, batch.column(6).to_numpy().view(np.uint64))
            ids, line, part, row = (batch.column(k).to_numpy() for k in (0, 1, 2, 5))
            new = np.ones(len(known), dtype=bool)
            new[1:] = ~known[:-1] | ~known[1:] | (ids[1:] != ids[:-1]) | (line[1:] != line[:-1]) | (row[1:] != row[:-1]) | (part[1:] != part[:-1] + 1)
            island = np.cumsum(new) - 1
            total = np.bincount(island, weights=batch.column(4).to_numpy() * known)
            if len(total):
                total[[0, -1]] = np.inf
            yield batch.filter(pa.array(known & (total[island] >= passage_words)))

    return run


def _merged(lines: list[list[str]], similarity: float) -> list[str | None]:
    """The template of each of a leaf's lines, which join the templates in the order given."""
    need = similarity * len(lines[0])
    codes: dict[str, int] = {VARIABLE: -1}
    rows = np.array([[codes.setdefault(w, len(codes)) for w in line] for line in lines], dtype=np.int32)
    enough = (rows >= 0).sum(axis=1) >= need
    shapes, n, member = np.empty_like(rows), 0, np.full(len(rows), -1)
    for k in np.flatnonzero(enough).tolist():
        same = (shapes[:n] == rows[k]) & (rows[k] >= 0)
        equal = same.sum(axis=1)
        best = int(equal.argmax()) if n else 0
        if n and equal[best] >= need:
            shapes[best][~same[best]] = -1
        else:
            best, n = n, n + 1
            shapes[best] = rows[k]
        member[k] = best
    names = list(codes)
    texts = [" ".join(names[c] if c >= 0 else VARIABLE for c in shape) for shape in shapes[:n].tolist()]
    return [texts[m] if m >= 0 else None for m in member.tolist()]


def _meet(similarity: float):
    """leaf, chunk, a, b, tokens, in the order of leaf and chunk -> leaf, chunk, a, b, template, without lines that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("leaf", pa.int64()), ("chunk", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("template", pa.string())])
        rows: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            found = _merged([r[4].split(" ") for r in rows], similarity) if len(rows) > 1 else [rows[0][4]]
            out.extend((*r[:4], text) for r, text in zip(rows, found) if text is not None)
            rows.clear()

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and rows[0][:2] != row[:2]:
                    close()
                    if len(out) >= 4096:
                        yield taken()
                rows.append(row)
        if rows:
            close()
        yield taken()

    return run


def _templates(distinct: DataFrame, similarity: float) -> DataFrame:
    """distinct (leaf, chunk, a, b, tokens) -> leaf, chunk, a, b, template, a template for each leaf and chunk's similar lines."""
    met = distinct.select("leaf", "chunk", "a", "b", "tokens").repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "a", "b")
    return met.mapInArrow(_meet(similarity), "leaf bigint, chunk bigint, a bigint, b bigint, template string")


def _shapes(rows: DataFrame, lines: DataFrame, depth: int, similarity: float) -> DataFrame:
    """a, b (a line's digest), c, d (its template's), template: of the lines that share a leaf with another document."""
    span = [F.min("id").alias("low"), F.max("id").alias("high")]
    per = F.greatest(F.lit(16), F.least(F.lit(CHUNK_LINES), F.floor(CHUNK_TOKENS / F.first("n"))))
    leaves = lines.where("leaf IS NOT NULL").groupBy("leaf").agg(*span, F.ceil(F.count("*") / per).alias("chunks")).where("low < high")
    leaves = materialize(leaves.select("leaf", "chunks"), "leaves")
    found = rows.mapInArrow(_candidates(depth, similarity, _filter_of(leaves, "leaf")), "leaf bigint, a bigint, b bigint, n int, tokens string")
    distinct = found.groupBy("leaf", "a", "b").agg(F.first("tokens").alias("tokens")).join(leaves, "leaf").withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod("a", "chunks")).otherwise(-1))
    shaped = materialize(_templates(distinct, similarity), "templates", "zstd")
    # the templates of a leaf's chunks, by their own digests
    name = [F.xxhash64("template").alias("c"), F.xxhash64("template", F.lit(1)).alias("d")]
    many = shaped.where("chunk >= 0").select("*", *name)
    parts = many.select("leaf", F.lit(-1).cast("bigint").alias("chunk"), F.col("c").alias("a"), F.col("d").alias("b"), F.col("template").alias("tokens")).dropDuplicates(["leaf", "a", "b"])
    wide = _templates(parts, similarity).select("leaf", F.col("a").alias("c"), F.col("b").alias("d"), F.col("template").alias("wide"))
    joined = many.join(wide, ["leaf", "c", "d"]).select("a", "b", F.col("wide").alias("template"))
    every = shaped.where("chunk < 0").select("a", "b", "template").unionAll(joined)
    return materialize(every.select("a", "b", *name, "template"), "shapes", "zstd")


def _passages(units: DataFrame, min_docs: int, passage_words: int) -> DataFrame:
    """id, line, row, passages: the runs of recurring segments."""
    segments = units.where("part > 0").drop("leaf")
    if min_docs == 2:
        often = segments.groupBy("a", "b").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    else:
        often = segments.groupBy("a", "b").agg(F.count_distinct("id").alias("docs")).where(F.col("docs") >= min_docs)
    often = materialize(often.select("a", "b"), "segments", "snappy")
    kinds = ", ".join(f"{c} {t}" for c, t in segments.dtypes)
    near = segments.mapInArrow(_runs(passage_words, _filter_of(often, "a")), kinds)
    hits = near.join(often, ["a", "b"], "left_semi").select("id", "line", "row", "part", "first", "n").dropDuplicates(["id", "line", "row", "part"])
    island = F.col("part") - F.row_number().over(Window.partitionBy("id", "line", "row").orderBy("part"))
    runs = hits.withColumn("island", island).groupBy("id", "line", "row", "island").agg(F.min("first").alias("first"), F.sum("n").cast("int").alias("n")).where(F.col("n") >= passage_words)
    return runs.groupBy("id", "line", "row").agg(F.array_sort(F.collect_list(F.struct("first", (F.col("first") + F.col("n")).alias("end")))).alias("passages"))


def _decided(docs: DataFrame, id_col: str, text_col: str, depth: int, similarity: float, min_docs: int, short_tokens: int, short_docs: int, passage_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, shapes, marks): all lines, the templates, and the lines (id, line, row) with often or passages."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text"))
    units = materialize(rows.mapInArrow(_units(depth, similarity, passage_words), _UNITS), "lines", "snappy")
    lines = units.where("part = 0")
    shapes = _shapes(rows, lines, depth, similarity)
    named = materialize(lines.where("leaf IS NOT NULL").select("id", "line", "row", "n", "a", "b").join(shapes.select("a", "b", "c", "d"), ["a", "b"]).select("id", "line", "row", "n", "c", "d"), "templated-lines", "snappy")
    support = named.groupBy("c", "d").agg(F.count_distinct("id").alias("docs"), F.max("n").alias("size")).where(F.when(F.col("size") < short_tokens, F.col("docs") >= short_docs).otherwise(F.col("docs") >= min_docs))
    support = materialize(support.select("c", "d"), "recurring")  # so that the join with it is a plain one, which can be split where a template is common
    gone = named.join(support, ["c", "d"], "left_semi").select("id", "line", "row").distinct()
    runs = _passages(units, min_docs, passage_words)
    marks = gone.withColumn("often", F.lit(True)).join(runs, ["id", "line", "row"], "full").withColumn("passages", F.when(F.col("often").isNull(), F.col("passages")))
    return lines, shapes, materialize(marks, "marks", "snappy")


def recurring_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = 2, short_tokens: int = 8, short_docs: int = 3,
    passage_words: int = PASSAGE_WORDS,
) -> DataFrame:
    """One row per line that isn't blank: id, line (number from 0), n (tokens), template, dropped, passages.

    Lines are split at ``\\n``, tokens at ``[\\x20\\x09-\\x0D]``.  template is null for
    a line without one and for one whose leaf no other document reaches.
    dropped: its template occurs in at least ``min_docs`` documents,
    ``short_docs`` where it has fewer than ``short_tokens`` tokens, since short
    lines coincide.  All lines of such a template are dropped.  passages: the
    recurring passages of a line that isn't dropped, each as its first token
    (from 0) and the one after its last; null if there is none.  They are runs
    of segments of longer lines with ``passage_words`` tokens or more, each of
    which recurs in ``min_docs`` documents.  Null and empty texts have no
    lines.  Rows that share an id are one document; a null id counts as one
    document.  Ids must be castable to bigint.  Other columns play no part.
    """
    lines, shapes, marks = _decided(docs, id_col, text_col, depth, similarity, min_docs, short_tokens, short_docs, passage_words)
    shaped = lines.where("leaf IS NOT NULL").join(shapes.select("a", "b", "template"), ["a", "b"]).unionByName(lines.where("leaf IS NULL"), allowMissingColumns=True)
    rest = lines.where("leaf IS NOT NULL").join(shapes.select("a", "b"), ["a", "b"], "left_anti")
    out = shaped.unionByName(rest, allowMissingColumns=True).join(marks, ["id", "line", "row"], "left")
    key = F.when(F.col("id") != -(1 << 63), F.col("id")).alias(id_col)
    return out.select(key, "line", "n", "template", F.coalesce("often", F.lit(False)).alias("dropped"), "passages")


def line_report(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = 2, short_tokens: int = 8, short_docs: int = 3,
    passage_words: int = PASSAGE_WORDS,
) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, n_words_dropped, dropped_lines, n_passages, dropped_passages.

    dropped_lines: their numbers in order, comma-joined.  dropped_passages, of
    lines that stay: line:first-end in order of the line and its tokens,
    comma-joined.  n_words_dropped counts both.  Rows that share an id get the
    sums of all of them.
    """
    lines, _, marks = _decided(docs, id_col, text_col, depth, similarity, min_docs, short_tokens, short_docs, passage_words)
    n_lines = lines.groupBy("id").agg(F.count("*").alias("n_lines"))
    own = lines.select("id", "line", "row", "n").join(marks, ["id", "line", "row"])
    gone = F.coalesce("often", F.lit(False))
    inside = F.aggregate("passages", F.lit(0), lambda s, p: s + p["end"] - p["first"])
    placed = F.transform("passages", lambda p: F.struct(F.col("line").alias("line"), p["first"].alias("first"), p["end"].alias("end")))
    shown = lambda p: F.concat(p["line"].cast("string"), F.lit(":"), p["first"].cast("string"), F.lit("-"), p["end"].cast("string"))
    each = own.groupBy("id").agg(
        F.count_if(gone).alias("n_dropped"), F.sum(F.when(gone, F.col("n")).otherwise(inside)).cast("bigint").alias("n_words_dropped"),
        F.array_join(F.array_sort(F.collect_set(F.when(gone, F.col("line")))).cast("array<string>"), ",").alias("dropped_lines"), F.sum(F.size(F.coalesce("passages", F.array()))).alias("n_passages"),
        F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list(placed))), shown), ",").alias("dropped_passages"),
    )
    key = F.col(id_col).cast("bigint")
    out = docs.select(key.alias(id_col), F.coalesce(key, F.lit(-(1 << 63))).alias("id")).join(n_lines, "id", "left").join(each, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(id_col, zero("n_lines"), zero("n_dropped"), zero("n_words_dropped"), empty("dropped_lines"), zero("n_passages"), empty("dropped_passages"))


def _starts(line: str) -> list[int]:
    """Where the tokens of a line start, and the line's end."""
    return [*(m.start() for m in _TOKEN.finditer(line)), len(line)]


def _without(text: str | None, gone: list | None, passages: list | None) -> str | None:
    if text is None:
        return None
    dropped, inside, kept = set(gone or ()), {}, []
    for p in passages or ():
        inside.setdefault(p["line"], []).append((p["first"], p["end"]))
    for number, line in enumerate(text.split("\n")):
        if number in dropped:
            continue
        if number in inside:
            at = _starts(line)
            for first, end in sorted(inside[number], reverse=True):
                line = line[: at[first]] + line[at[end] :]
        kept.append(line)
    return "\n".join(kept)


def drop_lines(docs: DataFrame, lines: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts less their dropped lines and passages."""
    placed = F.transform("passages", lambda p: F.struct(F.col("line").alias("line"), p["first"].alias("first"), p["end"].alias("end")))
    gone = lines.where("dropped OR passages IS NOT NULL").groupBy(F.col(id_col).alias("_k"))
    gone = gone.agg(F.collect_set(F.when(F.col("dropped"), F.col("line"))).alias("_gone"), F.flatten(F.collect_list(placed)).alias("_passages"))
    out = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_k")), "left")
    text = F.when(F.col("_k").isNull() & F.col("_gone").isNull(), F.col(text_col)).otherwise(F.udf(_without, "string", useArrow=False)(text_col, "_gone", "_passages"))
    return out.withColumn(text_col, text).select(*docs.columns)
