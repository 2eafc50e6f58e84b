"""Vectorised UTF-8 text handling for Arrow batches.

Everything works on the batch's own byte buffer: no Python string per word.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text is handled alone, whole.
BLOCK = 1 << 20

_U64 = np.uint64
_rng = np.random.default_rng(20240229)
#: A random word for each byte value, and an odd multiplier: fixed by the seed, so equal on all machines.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_STEP = 0x9E6C63D0876A9A35
_BITS = 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BACK = pow(_STEP, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["up"] = _powers(_STEP, 1 << _BITS)
        _TABLES["down"] = _powers(_BACK, 1 << _BITS)
    return _TABLES["up"], _TABLES["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    h ^= h >> _U64(29)
    h *= _U64(0xA0761D6478BD642F)
    h ^= h >> _U64(32)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts; the last offset is the end."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32) if column.buffers()[1] else np.zeros(1, np.int64)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first, end, bytes, offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] numbers for each i."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def starts_of_texts(offsets: np.ndarray, size: int) -> np.ndarray:
    """True at each byte with which a text begins."""
    mark = np.zeros(size + 1, dtype=bool)
    mark[offsets[:-1]] = True
    return mark[:size]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, and each text's first run (with the end).

    is_word: by byte value.  A run never crosses from one text to the next.
    """
    inside = is_word[data]
    new = starts_of_texts(offsets, len(data))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | new[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | new[1:]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def _hash(part_of: Callable[[int, int], np.ndarray], n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans of n values, of which part_of gives an own copy of a slice."""
    up, down = _tables()
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    scale = 1
    for at in range(0, n, 1 << _BITS):
        part = part_of(at, at + (1 << _BITS))
        part *= up[: len(part)]
        if at:
            part *= _U64(scale)
        part[:1] += sums[at : at + 1]
        np.cumsum(part, out=sums[at + 1 : at + 1 + len(part)])
        scale = scale * pow(_STEP, 1 << _BITS, 1 << 64) % (1 << 64)
    out = sums[ends] - sums[starts]
    out *= down[starts & ((1 << _BITS) - 1)]
    if n > 1 << _BITS:
        high = _powers(pow(_BACK, 1 << _BITS, 1 << 64), (n >> _BITS) + 1)
        out *= high[starts >> _BITS]
    out += (ends - starts).astype(np.uint64) * _U64(0x8CB92BA72F3D8DD7)
    return mix(out)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes, the same wherever the span lies."""
    return _hash(lambda a, b: _BYTE[data[a:b]], len(data), starts, ends)


def hash_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same of spans of word hashes."""
    return _hash(lambda a, b: words[a:b].copy(), len(words), starts, ends)


def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and leaves other bytes."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWER = lower_table()
#: Words of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Words of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` consecutive word hashes, whatever texts they are in."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        out += words[k : k + n] * _U64(factor)
        factor = factor * _STEP % (1 << 64)
    return mix(out + _U64(width))
