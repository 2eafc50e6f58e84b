"""Token-id shards: bit or byte planes of fixed-size blocks, zstandard, a chunk index.

File format (little-endian)
---------------------------
    "LTBP" | version u32 | block u32 | plane kind u32 (1 bits, 8 bytes)
    part u32 | seq u32 | before u64: the shard's place, and the ids of its part's earlier shards
    chunks: for each block of ids and each plane, a zstandard frame
    document table: zstandard frame of n_docs i64 ids and n_docs u64 lengths
    chunk index: n_chunks x (offset u64, size u32, ids u32)
    footer: document table offset u64, its size u64, n_docs u64, n_ids u64,
            index offset u64, n_chunks u64, "LTBP", a line feed

Each shard is a file of its own, written by Spark's writer and committed with
its task, so that a lost executor or a second attempt leaves no half file and
any store that Spark writes to will do.  The writer ends a record with a line
feed, which the format therefore ends with.  A block has ``block`` ids; the last of a shard has what is left.  A bit plane
holds one bit of every id of the block, a byte plane one byte.  A null document
id is stored as the least 64-bit integer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .textbytes import blocks, text_buffer
from .tokenizing import encoder
from .workspace import materialize, new_path

MAGIC, BLOCK_IDS, SHARD_IDS = b"LTBP", 1 << 16, 1 << 21
_NULL_ID = -(1 << 63)
_HEAD, _FOOTER = struct.Struct("<4sIIIIIQ"), struct.Struct("<QQQQQQ5s")
_END = MAGIC + b"\n"
_CHUNK = np.dtype([("offset", "<u8"), ("size", "<u4"), ("ids", "<u4")])


def _planes(ids: np.ndarray, kind: int) -> list[bytes]:
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if kind == 8:
        return [np.ascontiguousarray(r).tobytes() for r in rows]
    return [np.packbits((r >> k) & 1, bitorder="little").tobytes() for r in rows for k in range(8)]


def _unplane(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == 8:
        rows = [np.frombuffer(p, np.uint8) for p in planes]
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes]
        rows = [sum((bits[8 * r + k] << k for k in range(1, 8)), bits[8 * r].copy()) for r in range(4)]
    return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").ravel()


@dataclass
class Shard:
    """What a shard file holds: its place, the ids and lengths of its documents, all token ids."""

    part: int
    seq: int
    before: int
    doc_ids: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray


def encode_shard(shard: Shard, kind: int = 8, block: int = BLOCK_IDS, level: int = 3) -> bytes:
    """The bytes of one shard file."""
    pack = zstandard.ZstdCompressor(level=level).compress
    out, index, at = [_HEAD.pack(MAGIC, 2, block, kind, shard.part, shard.seq, shard.before)], [], _HEAD.size
    for k in range(0, len(shard.ids), block):
        ids = shard.ids[k : k + block]
        for plane in _planes(ids, kind):
            frame = pack(plane)
            index.append((at, len(frame), len(ids)))
            out.append(frame)
            at += len(frame)
    table = pack(shard.doc_ids.astype("<i8").tobytes() + shard.lengths.astype("<u8").tobytes())
    footer = _FOOTER.pack(at, len(table), len(shard.doc_ids), len(shard.ids), at + len(table), len(index), _END)
    return b"".join([*out, table, np.array(index, dtype=_CHUNK).tobytes(), footer])


def decode_shard(file: bytes) -> Shard:
    """A shard file's contents, found through its chunk index."""
    if file[:4] != MAGIC or file[-len(_END) :] != _END:
        raise ValueError("not a shard of bit-plane blocks")
    _, _, _, kind, part, seq, before = _HEAD.unpack_from(file)
    docs_at, docs_size, n_docs, n_ids, index_at, n_chunks, _ = _FOOTER.unpack_from(file, len(file) - _FOOTER.size)
    unpack = zstandard.ZstdDecompressor().decompress
    table = unpack(file[docs_at : docs_at + docs_size])
    index = np.frombuffer(file, dtype=_CHUNK, count=n_chunks, offset=index_at)
    per, out = 32 if kind == 1 else 4, []
    for k in range(0, n_chunks, per):
        frames = [unpack(file[int(c["offset"]) : int(c["offset"]) + int(c["size"])]) for c in index[k : k + per]]
        out.append(_unplane(frames, int(index[k]["ids"]), kind))
    ids = np.concatenate(out) if out else np.zeros(0, "<u4")
    if len(ids) != n_ids:
        raise ValueError("a chunk is missing")
    return Shard(part, seq, before, np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, "<u8", n_docs, 8 * n_docs), ids)


def _write(path: str, end_id: int, kind: int):
    """Shard files of the rows of a partition in their order; ``seq`` numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lengths, parts, held, done, seq = [], [], [], 0, 0, 0

        def file() -> pa.RecordBatch:
            shard = Shard(batch.column(2)[0].as_py(), seq, done, np.concatenate(docs), np.concatenate(lengths), np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([encode_shard(shard, kind)[:-1]], pa.binary())], names=["file"])

        batch = None
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            doc_ids = batch.column(0).fill_null(_NULL_ID).to_numpy()
            for a, b, part, at in blocks(data, offsets):
                ids, n = encoder(path).ids(part, at)
                n = n.astype(np.int64)
                edge = np.cumsum(n + 1)
                out = np.full(len(ids) + len(n), end_id, dtype="<u4")
                keep = np.ones(len(out), dtype=bool)
                keep[edge - 1] = False
                out[keep] = ids
                docs.append(doc_ids[a:b])
                lengths.append(n + 1)
                parts.append(out)
                held += len(out)
                if held >= SHARD_IDS:
                    yield file()
                    docs, lengths, parts, done, held, seq = [], [], [], done + held, 0, seq + 1
        if held:
            yield file()

    return run


def write_shards(
    docs: DataFrame, tokenizer_path: str, end_id: int, *, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte", partitions: int | None = None
) -> str:
    """Encode all texts, write the shard files in ascending order of the ids, and return their folder.

    folder: one that isn't there yet; without it, one below the shared folder,
    removed when the driver ends.  Null texts are empty, and a document has at
    least its end id.  Ids must be castable to bigint.  Null ids come first;
    rows that share an id are ordered by a hash of the text and the text, and
    may lie in several parts.  Shards hold about SHARD_IDS ids, more only where
    one block of texts has more.  An empty table has no shards.  Other columns
    play no part.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text", F.spark_partition_id().alias("part"))
    files = rows.mapInArrow(_write(tokenizer_path, end_id, {"bit": 1, "byte": 8}[planes]), "file binary")
    # a record of the text writer is its bytes as they are, and a line feed
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and content of the shard files of a folder."""
    return spark.read.format("binaryFile").load(folder).where("length > 0")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column(0):
            shard = decode_shard(file.as_py())
            raw, edge = memoryview(shard.ids).cast("B"), np.concatenate(([0], np.cumsum(shard.lengths.astype(np.int64))))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            keys = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == _NULL_ID)
            part = pa.array(np.full(len(keys), shard.part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [part, keys, pa.array(edge[:-1] + shard.before), pa.array(np.diff(edge)), pa.array(crc, pa.int64())],
                names=["part", "id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """From the files of a folder of shards, per document: id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it.  Each file is decoded
    once.  The ordered window is over a row for each part, which are as many as
    the writer had partitions, not shards or documents.
    """
    rows = shard_files(spark, folder).select("content").mapInArrow(_read, "part int, id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    rows = materialize(rows, "token-spans")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    offset = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("part", offset.alias("offset"))
    return rows.join(F.broadcast(totals), "part").select(F.col("id").alias(id_col), (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [_HEAD.unpack_from(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[4] for h in heads], pa.int64()), pa.array([h[5] for h in heads], pa.int64())], names=["path", "part", "seq"])


def read_ids(spark: SparkSession, folder: str) -> Iterator[np.ndarray]:
    """All ids of a folder of shards in order, one shard at a time on the driver."""
    files = shard_files(spark, folder)
    heads = files.select("path", F.substring("content", 1, _HEAD.size).alias("head")).mapInArrow(_places, "path string, part bigint, seq bigint")
    for row in files.join(heads, "path").orderBy("part", "seq").select("content").toLocalIterator():
        yield decode_shard(bytes(row.content)).ids
