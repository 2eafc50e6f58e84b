"""Progressive JPEG as a media column: coefficients, RGB tensors, and lossless payloads.

The decoder takes Huffman-coded progressive files of 8 bits, grey or in three
components, with or without restart intervals: it accumulates the scans
(spectral selection and successive approximation) into coefficient arrays,
applies the inverse transform with numpy, upsamples chroma and gives
full-resolution RGB.  Other kinds of files raise.  A scan whose codes turn out
to have one length is read as an array of bits; any other scan is read code by
code.  Samples are sums of integers, so that all machines give the same.

A payload is stored in the format's own lossless unit, the quantised
coefficient.  Byte b becomes b if it is over 127, else b - 255: a value of
eight bits, so never zero, whose magnitude bits in a scan are those of b.
The 63 AC coefficients of each block hold the bytes (DC is 0), in the scans

    DC; for each component: AC 1-5 and AC 6-63 without the lowest bit, then
    AC 1-63 with it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbytes import text_buffer
from .workspace import drop, materialize

UNIT, PER_BLOCK = 576, 63
#: Payload bytes of one image; a longer payload is a sequence of images.
IMAGE_BYTES = UNIT * 7000
#: Begins the comment with a payload's size.
_NOTE = b"payload="


def _zigzag() -> np.ndarray:
    """The raster place of each coefficient in zigzag order, from its rule."""
    cells = [(r + c, r if (r + c) % 2 else c, 8 * r + c) for r in range(8) for c in range(8)]
    return np.array([place for _, _, place in sorted(cells)])


ZIGZAG = _zigzag()


def _inverse() -> np.ndarray:
    """64 x 64: a row of zigzag coefficients times this gives a row of 8 x 8 samples."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(k == 0, np.sqrt(0.125), 0.5 * np.cos((2 * x + 1) * k * np.pi / 16))
    return np.rint(np.kron(basis, basis)[ZIGZAG] * (1 << _SCALE))


#: Bits of the inverse transform's factors: they and the coefficients are integers, whose sums double precision holds exactly.
_SCALE = 20
INVERSE = _inverse()
_SEGMENT_END, _RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7]"), re.compile(rb"\xff[\xd0-\xd7]")
_EOB_LENGTH = 5
_HEAD_TABLES = (
    b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([1] * 64)
    + b"\xff\xc4" + struct.pack(">HB", 20, 0x00) + bytes([1] + [0] * 15) + bytes([0])
    + b"\xff\xc4" + struct.pack(">HB", 35, 0x10) + bytes([1, 0, 0, 0, 15] + [0] * 11) + bytes([0x07] + [n << 4 for n in range(15)])
)


def _scan(components: tuple[int, ...], first: int, last: int, high: int, low: int, codes: bytes) -> bytes:
    head = struct.pack(">HB", 6 + 2 * len(components), len(components)) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low])
    return b"\xff\xda" + head + codes.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, dtype=np.uint8)))).tobytes()


def _bits_of(value: int, n: int) -> np.ndarray:
    return np.array([value >> k & 1 for k in range(n - 1, -1, -1)], dtype=np.uint8)


def _refinement(bits: np.ndarray) -> np.ndarray:
    """Correction bits (a row for each block), after the runs that say there is nothing new."""
    out = []
    for k in range(0, len(bits), 32767):
        rows = bits[k : k + 32767]
        n = len(rows).bit_length() - 1
        out += [_bits_of(16 + n, _EOB_LENGTH), _bits_of(len(rows) - (1 << n), n), rows.ravel()]
    return np.concatenate(out)


def _encode_image(payload: np.ndarray) -> bytes:
    mcus = -(-len(payload) // (6 * PER_BLOCK))
    tall = max(1, int(mcus**0.5))
    wide = -(-mcus // tall)
    count = wide * tall
    cells = np.zeros(6 * count * PER_BLOCK, dtype=np.uint8)
    cells[: len(payload)] = payload
    cells = cells.reshape(-1, PER_BLOCK)
    note = _NOTE + b"%d" % len(payload)
    out = [b"\xff\xd8\xff\xfe", struct.pack(">H", 2 + len(note)), note, _HEAD_TABLES]
    out.append(b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 16 * tall, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out.append(_scan((1, 2, 3), 0, 0, 0, 0, _packed(np.zeros(6 * count, dtype=np.uint8))))
    edges = (0, 4 * count, 5 * count, 6 * count)
    for c in range(3):
        part = cells[edges[c] : edges[c + 1]]
        codes = part >> 1  # the code of one bit, 0, and seven magnitude bits
        out.append(_scan((c + 1,), 1, 5, 0, 1, codes[:, :5].tobytes()))
        out.append(_scan((c + 1,), 6, 63, 0, 1, codes[:, 5:].tobytes()))
        out.append(_scan((c + 1,), 1, 63, 1, 0, _packed(_refinement((part & 1) ^ (part < 128)))))
    out.append(b"\xff\xd9")
    return b"".join(out)


def encode_payload(payload: bytes) -> bytes:
    """One image, or several one after the other for a long payload."""
    data = np.frombuffer(payload, np.uint8)
    return b"".join(_encode_image(data[k : k + IMAGE_BYTES]) for k in range(0, len(data), IMAGE_BYTES))


class _Huffman:
    """A table by (length, code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols, code, at = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.symbols[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1

    def only(self) -> int | None:
        """The symbol with the code 0 of one bit, if there is one."""
        return self.symbols.get((1, 0))


class _Bits:
    def __init__(self, bits: np.ndarray):
        self.bits, self.at = bits, 0

    def take(self, n: int) -> int:
        value = 0
        for k in range(self.at, self.at + n):
            value = value << 1 | (int(self.bits[k]) if k < len(self.bits) else 1)
        self.at += n
        return value

    def symbol(self, table: _Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table.symbols:
                return table.symbols[length, code]
        raise ValueError("a code that the table lacks")


def _extend(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


def _ac_first_plain(coefs: np.ndarray, order: np.ndarray, ss: int, se: int, al: int, table: _Huffman, bits: np.ndarray) -> bool:
    """Reads the scan as one array if every code is the one of one bit; False if not."""
    size = table.only()
    if size is None or not 0 < size < 16:
        return False
    width, n = 1 + size, len(order) * (se - ss + 1)
    if not width * n <= len(bits) < width * n + 8:
        return False
    cells = bits[: width * n].reshape(n, width)
    if cells[:, 0].any():
        return False
    value = cells[:, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32)) if size > 8 else (np.packbits(cells[:, 1:], axis=1)[:, 0] >> (8 - size)).astype(np.int32)
    value = np.where(cells[:, 1] == 1, value, value - (1 << size) + 1)
    coefs[order, ss : se + 1] = (value << al).reshape(len(order), -1)
    return True


def _ac_first_bytes(coefs: np.ndarray, order: np.ndarray, ss: int, se: int, al: int, table: _Huffman, data: bytes) -> bool:
    """The same where a code of one bit and seven magnitude bits make a byte each."""
    if table.only() != 7 or len(data) != len(order) * (se - ss + 1):
        return False
    cells = np.frombuffer(data, np.uint8)
    if (cells >= 128).any():
        return False
    value = cells.astype(np.int16)
    coefs[order, ss : se + 1] = (np.where(value >= 64, value, value - 127) << al).reshape(len(order), -1)
    return True


def _ac_first(coefs: np.ndarray, order: np.ndarray, ss: int, se: int, al: int, table: _Huffman, reader: _Bits) -> None:
    run = 0
    for block in order:
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            r, s = divmod(reader.symbol(table), 16)
            if s:
                k += r
                coefs[block, k] = _extend(reader.take(s), s) << al
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1 + (reader.take(r) if r else 0)
                break


def _ac_refine(coefs: np.ndarray, order: np.ndarray, ss: int, se: int, al: int, table: _Huffman, reader: _Bits, plain: bool) -> None:
    step = 1 << al

    def correct(block: int, k: int) -> None:
        if reader.take(1):
            coefs[block, k] += step if coefs[block, k] > 0 else -step

    band = coefs[:, ss : se + 1]
    full = plain and bool(band[order].all())
    i, run = 0, 0
    while i < len(order):
        block, k = order[i], ss
        if not run:
            while k <= se:
                r, s = divmod(reader.symbol(table), 16)
                if not s and r < 15:
                    run = (1 << r) + (reader.take(r) if r else 0)
                    break
                new = (step if reader.take(1) else -step) if s else 0
                while k <= se:
                    if coefs[block, k]:
                        correct(block, k)
                    elif r == 0:
                        break
                    else:
                        r -= 1
                    k += 1
                if k <= se and s:
                    coefs[block, k] = new
                k += 1
        if run and full and k == ss:
            rows = order[i : i + run]
            n = len(rows) * (se - ss + 1)
            bits = reader.bits[reader.at : reader.at + n].reshape(len(rows), -1)
            reader.at += n
            sign = np.where(band[rows] > 0, step, -step)
            band[rows] += (bits * sign).astype(coefs.dtype)
            i, run = i + len(rows), run - len(rows)
            continue
        if run:
            for j in range(k, se + 1):
                if coefs[block, j]:
                    correct(block, j)
            run -= 1
        i += 1


class Image:
    """A decoded file: coefficient arrays by component, in zigzag order, and what is needed for samples."""

    def __init__(self, width: int, height: int, components: list[dict], plain: bool = True):
        self.width, self.height, self.components, self.plain = width, height, components, plain
        self.note = b""
        h, v = max(c["h"] for c in components), max(c["v"] for c in components)
        self.wide, self.tall, self.h, self.v = -(-width // (8 * h)), -(-height // (8 * v)), h, v
        for c in components:
            c["cols"], c["rows"] = self.wide * c["h"], self.tall * c["v"]
            c["coefs"] = np.zeros((c["cols"] * c["rows"], 64), dtype=np.int16)

    def _order(self, own: list[dict]) -> list[np.ndarray]:
        """For each component of a scan, its blocks in the scan's order; interleaved ones by MCU."""
        if len(own) == 1:
            c = own[0]
            cols = -(-(-(-self.width * c["h"] // self.h)) // 8)
            rows = -(-(-(-self.height * c["v"] // self.v)) // 8)
            return [(np.arange(rows)[:, None] * c["cols"] + np.arange(cols)).ravel()]
        out = []
        for c in own:
            grid = np.arange(c["rows"] * c["cols"]).reshape(self.tall, c["v"], self.wide, c["h"])
            out.append(grid.transpose(0, 2, 1, 3).reshape(self.tall * self.wide, -1))
        return out

    def scan(self, own: list[dict], ss: int, se: int, ah: int, al: int, tables: dict, data: bytes, interval: int = 0) -> None:
        """Accumulate a scan. interval: MCUs between restarts, 0 without them."""
        order = self._order(own)
        if ss == 0 and len(own) == 1:
            order = [order[0][:, None]]
        pieces = _RESTART.split(data) if interval else [data]
        step = interval or max(1, len(order[0]))
        if len(pieces) != max(1, -(-len(order[0]) // step)):
            raise ValueError("the restarts of a scan don't fit its interval")
        for k, piece in enumerate(pieces):
            self._piece(own, [o[k * step : (k + 1) * step] for o in order], ss, se, ah, al, tables, piece.replace(b"\xff\x00", b"\xff"))

    def _piece(self, own: list[dict], order: list[np.ndarray], ss: int, se: int, ah: int, al: int, tables: dict, data: bytes) -> None:
        """What lies between two restarts: predictions and runs start anew."""
        if ss == 0:
            if not ah and self.plain and all(set(tables[0, c["dc"]].symbols.values()) == {0} for c in own):
                return  # every difference is zero
            reader = _Bits(np.unpackbits(np.frombuffer(data, np.uint8)))
            before = [0] * len(own)
            for mcu in range(len(order[0])):
                for i, c in enumerate(own):
                    for block in order[i][mcu]:
                        if ah:
                            c["coefs"][block, 0] |= reader.take(1) << al
                        else:
                            size = reader.symbol(tables[0, c["dc"]])
                            before[i] += _extend(reader.take(size), size)
                            c["coefs"][block, 0] = before[i] << al
            return
        c, table = own[0], tables[1, own[0]["ac"]]
        if not ah and self.plain and _ac_first_bytes(c["coefs"], order[0], ss, se, al, table, data):
            return
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        if ah:
            _ac_refine(c["coefs"], order[0], ss, se, al, table, _Bits(bits), self.plain)
        elif not (self.plain and _ac_first_plain(c["coefs"], order[0], ss, se, al, table, bits)):
            _ac_first(c["coefs"], order[0], ss, se, al, table, _Bits(bits))

    def samples(self) -> list[np.ndarray]:
        """Each component's samples of 8 bits, a row for each block."""
        return [samples_of(c["coefs"], c["quant"]) for c in self.components]

    def rgb(self, samples: list[np.ndarray] | None = None) -> np.ndarray:
        """Height x width x 3 samples of 8 bits. samples: those of ``samples()``, if they are there already."""
        planes = []
        for c, own in zip(self.components, samples or self.samples(), strict=True):
            plane = own.reshape(c["rows"], c["cols"], 8, 8).transpose(0, 2, 1, 3).reshape(8 * c["rows"], 8 * c["cols"])
            if c["v"] != self.v:
                plane = np.repeat(plane, self.v // c["v"], axis=0)
            if c["h"] != self.h:
                plane = np.repeat(plane, self.h // c["h"], axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        out = np.empty((self.height, self.width, 3), dtype=np.uint8)
        y, cb, cr = planes
        out[:, :, 0] = np.clip(y + _TO_RED[cr], 0, 255)
        out[:, :, 1] = np.clip(y - (_TO_GREEN_B[cb] + _TO_GREEN_R[cr] >> 16), 0, 255)
        out[:, :, 2] = np.clip(y + _TO_BLUE[cb], 0, 255)
        return out


#: What chroma adds to luma, in integers.
_CHROMA = np.arange(256) - 128
_TO_RED, _TO_BLUE = ((round(x * 65536) * _CHROMA + 32768 >> 16).astype(np.int16) for x in (1.402, 1.772))
_TO_GREEN_B, _TO_GREEN_R = (round(0.344136 * 65536) * _CHROMA + 32768).astype(np.int32), (round(0.714136 * 65536) * _CHROMA).astype(np.int32)


def samples_of(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples of 8 bits of rows of coefficients."""
    out = coefs.astype(np.float64) @ (INVERSE * quant[:, None])
    out *= 1 / (1 << _SCALE)
    out += 128.5
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


def decode_images(media: bytes, plain: bool = True) -> Iterator[Image]:
    """The images of a media value, one after the other. plain: allow scans to be read as arrays."""
    at, image, tables, quants, note, interval = 0, None, {}, {}, b"", 0
    while at < len(media):
        if media[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = media[at + 1]
        at += 2
        if marker == 0xD8:
            image, tables, quants, note, interval = None, {}, {}, b"", 0
            continue
        if marker == 0xD9:
            yield image
            continue
        size = struct.unpack_from(">H", media, at)[0]
        body, at = media[at + 2 : at + size], at + size
        if marker == 0xFE:
            note = body
        elif marker == 0xDB:
            while body:
                wide = 128 if body[0] >> 4 else 64
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if wide == 128 else np.uint8).astype(np.float64)
                body = body[1 + wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC2, 0xC8, 0xCC):
            raise ValueError("not a progressive file with Huffman codes")
        elif marker == 0xC2:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not height or not width:
                raise ValueError("not an image of 8 bits and one or three components")
            parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
            image = Image(width, height, [{"id": p[0], "h": p[1] >> 4, "v": p[1] & 15, "quant": quants[p[2]]} for p in parts], plain)
            image.note = note
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan without a frame")
            own = []
            for k in range(body[0]):
                c = next(c for c in image.components if c["id"] == body[1 + 2 * k])
                c["dc"], c["ac"] = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                own.append(c)
            ss, se, approx = body[1 + 2 * body[0] :]
            end = _SEGMENT_END.search(media, at)
            if end is None:
                raise ValueError("the file ends inside a scan")
            image.scan(own, ss, se, approx >> 4, approx & 15, tables, media[at : end.start()], interval)
            at = end.start()


def payload_of(image: Image) -> bytes:
    """The bytes that encode_payload stored."""
    cells = np.concatenate([c["coefs"][:, 1:].ravel() for c in image.components])
    cells = np.where(cells > 0, cells, cells + 255).astype(np.uint8)
    return cells[: int(image.note.removeprefix(_NOTE))].tobytes()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for first in range(0, batch.num_rows, 256):  # media of a few documents at a time
            part = batch.slice(first, 256)
            edges = offsets[first : first + 257]
            media = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                raw = data[a:b].tobytes()
                media.append(encode_payload(raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(edges)), pa.array(media, pa.large_binary()).cast(pa.binary())], names=["id", "n_bytes", "media"])


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media column: id, n_bytes, media (a progressive JPEG value) for each row.

    A text is stored as UTF-8 with bytes 255 up to a positive multiple of 576;
    null counts as empty.  Ids may be null or repeat; other columns play no part.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_encode, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def _tensors(keys: list[str]):
    """The keys, digests of the value, and the tensors of its images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):  # tensors of a few values at a time
                part = batch.slice(first, 64)
                stored = [v.as_py() or b"" for v in part.column(len(keys))]
                images = [list(decode_images(v)) for v in stored]
                flat = [i for row in images for i in row]
                planes = _samples_of_all(flat)
                rgb = [i.rgb(p).tobytes() for i, p in zip(flat, planes)]
                edge = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in images]))).astype(np.int32))
                listed = lambda values, kind: pa.ListArray.from_arrays(edge, pa.array(values, kind))
                raw = [b"".join(payload_of(i) if i.note.startswith(_NOTE) else b"" for i in row) for row in images]
                yield pa.RecordBatch.from_arrays([
                    *part.columns[: len(keys)], pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([zlib.crc32(r[-32:]) for r in raw], pa.int64()),
                    pa.array([len(v) for v in stored], pa.int64()), pa.array([hashlib.sha256(v).hexdigest() for v in stored]),
                    listed([i.height for i in flat], pa.int32()), listed([i.width for i in flat], pa.int32()), listed(rgb, pa.binary()),
                ], names=[*keys, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "heights", "widths", "rgb"])

    return run


def _samples_of_all(images: list[Image]) -> list[list[np.ndarray]]:
    """``samples`` of many images, those with equal quantisers in one product."""
    groups: dict[bytes, list[tuple[int, int]]] = {}
    out: list[list] = [[None] * len(i.components) for i in images]
    for k, image in enumerate(images):
        for j, c in enumerate(image.components):
            groups.setdefault(c["quant"].tobytes(), []).append((k, j))
    for quant, places in groups.items():
        own = [images[k].components[j]["coefs"] for k, j in places]
        edge = np.cumsum([len(c) for c in own])[:-1]
        for (k, j), part in zip(places, np.split(samples_of(np.concatenate(own), np.frombuffer(quant)), edge)):
            out[k][j] = part
    return out


def rgb_tensors(media: DataFrame, *, media_col: str = "media", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each value: the keys, digests of the stored value and its payload, and its tensors.

    heights, widths, rgb: arrays with an entry for each image; an rgb entry is
    height * width * 3 bytes.  A null or empty value has no images.  A payload
    is read where the images carry one.  Whatever isn't a progressive file of 8
    bits and one or three components raises.
    """
    kinds = dict(media.dtypes)
    rows = media.select(*[F.col(c).alias(f"k{k}") for k, c in enumerate(key_cols)], F.col(media_col).alias("media"))
    keys = [f"k{k}" for k in range(len(key_cols))]
    schema = ", ".join(f"{k} {kinds[c]}" for k, c in zip(keys, key_cols)) + ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, heights array<int>, widths array<int>, rgb array<binary>"
    return rows.mapInArrow(_tensors(keys), schema).withColumnsRenamed(dict(zip(keys, key_cols)))


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before heights, widths and rgb, and the feature."""
    for batch in batches:
        out, n = [], batch.num_columns - 3
        for heights, widths, tensors in zip(*(batch.column(n + k) for k in range(3))):
            sums, pixels = np.zeros(3, dtype=np.int64), 0
            for tensor in tensors.values:
                own = np.frombuffer(tensor.as_buffer(), np.uint8).reshape(-1, 3)
                sums += own.sum(axis=0, dtype=np.int64)
                pixels += len(own)
            shapes = "+".join(f"{w}x{h}" for w, h in zip(widths.as_py(), heights.as_py()))
            out.append(shapes + ":" + ",".join(str(int(s) * 100 // max(1, pixels)) for s in sums))
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.string())], names=[*batch.schema.names[:n], "feature"])


def features(tensors: DataFrame) -> DataFrame:
    """``rgb_tensors`` with ``feature`` in place of the tensors: the images' sizes and the mean red, green and blue in hundredths, rounded down."""
    rest = [c for c in tensors.columns if c not in ("heights", "widths", "rgb")]
    kinds = dict(tensors.dtypes)
    return tensors.select(*rest, "heights", "widths", "rgb").mapInArrow(_means, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", feature string")


def store_and_describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8) -> DataFrame:
    """Store the media of all texts and then their tensors, and read the features back.

    One row per input row: id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature.  Media and tensors are
    tables of their own, each written whole before it is read.  They are several
    times as large as the texts, so the documents are taken in ``rounds`` parts
    by a hash of id and text; a part's tables are removed when it has been described.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(rounds))
    out = None
    for k in range(rounds):
        media = materialize(store_texts(rows.where(part == k), id_col="id"), "media", "zstd")
        tensors = materialize(rgb_tensors(media, key_cols=("id", "n_bytes")), "tensors", "none")
        own = materialize(features(tensors), "features")
        drop(media)
        drop(tensors)
        out = own if out is None else out.unionByName(own)
    return out.withColumnRenamed("id", id_col)
