"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact check.

Plan
----
1. Every text becomes its set of word shingles (64-bit hashes).  Equal sets are
   collapsed by a 128-bit digest, so copies never meet each other.
2. The distinct sets get ``bands * rows`` MinHash values.  A band key that
   several sets share makes a bucket; its least member (under one of two bit
   masks, so that buckets of one group choose different pivots) is the pivot,
   and every member is a candidate with its pivot only: the number of
   candidates is linear in the rows, however large a group is.
3. Candidates are compared on an independent signature in batches.  After each
   batch, a pair goes when the posterior probability of reaching the threshold
   is below ``miss``.
4. Survivors are verified on their full sets.
5. What no pivot joined (an outlier of its buckets) is compared with all members
   of the buckets of that pivot's component: small families as pairs, by steps
   3 and 4; large ones in tiles of bounded numbers of documents, whose pairs
   are pruned and verified as matrices and never become rows.  So no pair of a
   bucket is left undecided.
6. Components of the verified links give the class ids.

With the default bands a pair at similarity 0.8 shares no bucket with
probability (1 - 0.8**8)**64 = 8e-6, and less above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .textbytes import LOWER, NOT_SPACE, blocks, hash_spans, mix, text_buffer, window_hashes, word_spans
from .workspace import materialize

BANDS, ROWS, EXTRA = 64, 8, 96
_rng = np.random.default_rng(7)
_MUL = (_rng.integers(0, 1 << 32, BANDS * ROWS + EXTRA, dtype=np.uint32) | np.uint32(1))
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS + EXTRA, dtype=np.uint32)
#: Masks of the ids whose least is the pivot, by the key's last bit.
_MASKS = (0, 0x2AAAAAAAAAAAAAAA)
#: A family with more pairs of an outlier and a member than this is compared in tiles of TILE documents a side.
PAIRS, TILE = 4096, 512
#: Size of the filter of wanted ids: 2 ** 24 bits are 2 MB.
FILTER_BITS = 24


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes.

    A text with fewer words than ``width`` but not none has its whole sequence
    as one shingle.
    """
    for _, _, part, at in blocks(data, offsets):
        part = LOWER[part]
        starts, ends, first = word_spans(part, at, NOT_SPACE)
        words = hash_spans(part, starts, ends)
        full = window_hashes(words, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                got = np.sort(full[a : b - width + 1])
                yield got[np.concatenate(([True], got[1:] != got[:-1]))] if len(got) > 1 else got
            elif b > a:
                yield window_hashes(words[a:b], b - a)
            else:
                yield full[:0]


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set that is not empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_MUL), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), 512):
        got = np.multiply.outer(low[k : k + 512], _MUL)
        got += _ADD
        np.minimum(out, got.min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of signatures."""
    pairs = np.ascontiguousarray(signatures[:, : BANDS * ROWS]).view(np.uint64).reshape(len(signatures), BANDS, ROWS // 2)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), pairs.shape[:2]).copy()
    for k in range(ROWS // 2):
        key = mix(key ^ pairs[:, :, k])
    return key


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            sizes, digests, rows = [], [], []
            for got in shingle_sets(data, offsets, width):
                sizes.append(len(got))
                digests.append(xxhash.xxh3_128_digest(got.tobytes()) if len(got) else None)
                if len(got):
                    rows.append(minhash(got))
            full = np.array(sizes, dtype=np.int64) > 0
            signatures = np.array(rows, dtype=np.uint32).reshape(len(rows), len(_MUL))
            counts = np.where(full, BANDS, 0)
            keys = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(band_keys(signatures).view(np.int64).ravel())
            )
            low = iter(signatures[:, BANDS * ROWS :].astype(np.uint8))
            extra = pa.array([next(low).tobytes() if f else None for f in full], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), keys, extra],
                names=["id", "n", "digest", "keys", "sig"],
            )

    return run


@lru_cache(maxsize=8)
def prune_below(threshold: float, miss: float, total: int = EXTRA, step: int = 16) -> tuple[int, ...]:
    """For each batch end, the least number of agreeing values with which a pair stays.

    The prior of the similarity s is uniform; one byte of a MinHash agrees with
    probability s + (1 - s) / 256.  A pair goes when P(s >= threshold | seen) < miss.
    """
    s = np.linspace(0, 1, 4001)
    q = np.log(np.clip(s + (1 - s) / 256, 1e-300, 1)), np.log(np.clip((1 - s) * 255 / 256, 1e-300, 1))
    out = []
    for n in range(step, total + 1, step):
        for m in range(n + 1):
            like = m * q[0] + (n - m) * q[1]
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() / like.sum() >= miss:
                break
        out.append(m)
    return tuple(out)


def _bayes(threshold: float, miss: float, step: int = 16):
    bounds = prune_below(threshold, miss, EXTRA, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, EXTRA) for k in (2, 3))
            alive, same = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for k, least in enumerate(bounds):
                part = slice(k * step, (k + 1) * step)
                same[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                alive = alive[same[alive] >= least]
            yield batch.select([0, 1]).take(pa.array(alive))

    return run


def _sets(width: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            got = [s.tobytes() for s in shingle_sets(*text_buffer(batch.column(1)), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["id", "shingles"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents whose ids are wanted, and of a few more.

    The wanted ids go to the workers as a filter of 2 ** FILTER_BITS bits, so
    that the texts of other documents are not shuffled.  The filter's size
    doesn't grow with the data; a full one lets more sets through, and the
    joins that follow drop them.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("m")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bits[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    return docs.where("id IS NOT NULL").select("id", "text", slot.alias("slot")).mapInArrow(_sets(width, shared), "id bigint, shingles binary")


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b", "sa", "sb")
    close = materialize(close.mapInArrow(_bayes(percent / 100, miss), "a bigint, b bigint").distinct(), "survivors")
    wanted = close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct()
    sets = materialize(_sets_of(docs, wanted, width), "sets")
    full = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"x{c}"))
    both = close.join(full("a"), "a").join(full("b"), "b").select("a", "b", "xa", "xb")
    return both.mapInArrow(_similar(percent), "a bigint, b bigint").distinct()


def _tile(percent: int, miss: float, step: int = 16):
    """(a, b): the components of two sides of a tile that a verified link joins."""
    bounds = prune_below(percent / 100, miss, EXTRA, step)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        for table in (left, right):
            own = table["own"].to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            sides.append((own, np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, EXTRA), sets, sizes))
        (own, sig, sets, n), (own2, sig2, sets2, n2) = sides
        alive = own[:, None] != own2[None, :]
        alive &= 100 * np.minimum.outer(n, n2) >= percent * np.maximum.outer(n, n2)
        same = np.zeros(alive.shape, dtype=np.int16)
        for k, least in enumerate(bounds):
            if not alive.any():
                break
            for j in range(k * step, (k + 1) * step):
                same += sig[:, j, None] == sig2[None, :, j]
            alive &= same >= least
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        both = np.zeros((len(rows), len(columns)), dtype=np.float32)
        if len(rows):
            flat = [np.concatenate([part[k] for k in which]) for part, which in ((sets, rows), (sets2, columns))]
            shared = np.intersect1d(*flat)
            at = [np.searchsorted(shared, f) for f in flat]
            ok = [(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == f) if len(shared) else np.zeros(len(f), bool) for p, f in zip(at, flat)]
            doc = [np.repeat(np.arange(len(which)), size[which]) for which, size in ((rows, n), (columns, n2))]
            for c in range(0, len(shared), 4096):
                pair = []
                for p, good, d, which in zip(at, ok, doc, (rows, columns)):
                    take = good & (p >= c) & (p < c + 4096)
                    dense = np.zeros((len(which), min(4096, len(shared) - c)), dtype=np.float32)
                    dense[d[take], p[take] - c] = 1
                    pair.append(dense)
                both += pair[0] @ pair[1].T
        union = n[rows][:, None] + n2[columns][None, :] - both
        good = alive[np.ix_(rows, columns)] & (100 * both >= percent * union)
        i, j = np.nonzero(good)
        links = np.unique(np.stack([own[rows][i], own2[columns][j]], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})

    return run


def _residue(labelled: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, percent: int, miss: float) -> DataFrame | None:
    """Links (a, b) between outliers and other members of their families, or None if there are no outliers.

    labelled: (main, id, own): the component of a bucket's pivot, a member, the member's component.
    """
    family = labelled.groupBy("main").agg(F.count("*").alias("s"), F.count_if(F.expr("own <> main")).alias("o")).where("o > 0")
    family = materialize(family, "family-sizes")  # so that the join with it is a plain one, which can be split where a family is large
    family = materialize(labelled.join(family, "main"), "families")
    if family.isEmpty():
        return None
    outlier = F.col("own") != F.col("main")
    small, large = family.where(f"s * o <= {PAIRS}"), family.where(f"s * o > {PAIRS}")
    x = small.where(outlier).select("main", F.col("id").alias("x"), F.col("own").alias("x_own"))
    pairs = x.join(small.select("main", "id", "own"), "main").where("x_own <> own AND (x < id OR own = main)")
    pairs = pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    links = _verified(pairs, sketches, docs, width, percent, miss)
    if large.isEmpty():
        return links
    ids = large.select("id").distinct()
    sets = _sets_of(docs, ids, width)
    full = materialize(large.join(sketches.select("id", "sig"), "id").join(sets, "id"), "family-sets")
    full = full.withColumn("sb", F.pmod(F.xxhash64("id"), F.ceil(F.col("s") / TILE))).withColumn("ob", F.pmod(F.xxhash64("id"), F.ceil(F.col("o") / TILE)))
    columns = ["main", "sb", "ob", "own", "sig", "shingles"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / TILE) - 1))
    left = full.withColumn("ob", every("o")).select(columns)
    right = full.where(outlier).withColumn("sb", every("s")).select([F.col(c).alias(c) for c in columns])
    keys = ["main", "sb", "ob"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(percent, miss), "a bigint, b bigint")
    return links.unionByName(found)


def _pivot() -> Column:
    """The pivot of a bucket: its least id under the mask that the key picks."""
    least = [F.min(F.when(F.col("key").bitwiseAND(1) == k, F.col("id").bitwiseXOR(mask))) for k, mask in enumerate(_MASKS)]
    return F.coalesce(*[m.bitwiseXOR(mask) for m, mask in zip(least, _MASKS)])


def near_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-6
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is
    its distinct shingles of ``width`` words.  Documents are linked when
    100 * intersection >= percent * union; component_id is the least id that
    can be reached.  Sets are of 64-bit hashes and confirmed whole: in a pair of
    sets of n shingles, n * n / 2 ** 64 are expected to be taken for equal wrongly.
    Ids must be castable to bigint.

    Null, empty and blank texts have no set, n_shingles 0, and are linked with
    nothing: component_id is their own id.  Repeated rows and ties fall in one
    component by equal sets; rows that share an id are one vertex.  A row with
    a null id gets the component of its equals, or null.  Other columns of
    ``docs`` play no part and may have any names.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, n bigint, digest binary, keys array<bigint>, sig binary"
    table = materialize(rows.mapInArrow(_sketch(width), schema), "sketches")

    groups = materialize(table.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")), "groups")
    reps = table.where("n > 0").join(groups.select(F.col("rep").alias("id")), "id", "left_semi")
    sketches = reps.select("id", "n", "sig")
    entries = reps.select("id", F.explode("keys").alias("key"))

    buckets = entries.groupBy("key").agg(F.count("*").alias("c"), _pivot().alias("pivot")).where("c > 1").select("key", "pivot")
    members = materialize(entries.join(buckets, "key"), "members")

    tested = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = materialize(_verified(tested, sketches, rows, width, percent, miss), "links")
    label = connected_components(links)

    labelled = members.join(label.select("id", F.col("component").alias("own")), "id", "left").withColumn("own", F.coalesce("own", "id"))
    labelled = labelled.join(label.select(F.col("id").alias("pivot"), F.col("component").alias("main")), "pivot", "left")
    labelled = labelled.select(F.coalesce("main", "pivot").alias("main"), "id", "own").distinct()
    more = _residue(materialize(labelled, "labelled"), sketches, rows, width, percent, miss)
    final = label if more is None else connected_components(materialize(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "links"))

    classes = groups.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left")
    classes = classes.select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = table.select("id", "n", "digest").join(classes, "digest", "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
