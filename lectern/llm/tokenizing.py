"""Exact token ids and counts of the ``tokenizers`` library, through its units.

A byte-pair tokenizer first cuts a text into pieces and encodes each piece by
itself.  Texts are cut here, vectorised, at a subset of those places; each
distinct unit is encoded by the library once per Python worker and looked up
afterwards by its 64-bit hash.  The two layouts are

* ``spaced``: the byte-level kind whose pieces may begin with one space and
  whose white-space runs are pieces;
* ``dropped``: the kind that drops white space between pieces.

Whatever the cut rules can't prove safe (special-token text, white space beyond
ASCII in the spaced kind) goes to the library as a whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np

from . import tokenizer_files
from .textbytes import blocks, expand, hash_spans, starts_of_texts

#: Places of a worker's cache of units, and ids that a place holds: 45 bytes each, 47 MB whatever the texts. A unit
#: with more ids, or whose two places are taken by others, is encoded anew in each block; that changes no result.
CACHE_BITS, CACHED_IDS = 20, 9

_CLASS = np.full(256, 3, dtype=np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
#: Bytes after which letters can't be told from other signs by class: a chunk that holds one stays whole.
_HARD = np.zeros(256, dtype=bool)
_HARD[[39, 124, *range(0, 9), *range(14, 32), 127]] = True
_HARD[0xC2] = _HARD[0xCA:] = True


def _hard_bytes(data: np.ndarray) -> np.ndarray:
    """Apostrophes, bars, control bytes and all that isn't a Latin letter of two bytes."""
    hard = _HARD[data]
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        hard[:-1] |= (a == 0xC3) & ((b == 0x97) | (b == 0xB7))
        hard[:-1] |= (a == 0xC4) & (b == 0xB0)  # its lower case holds a mark
    return hard


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII (and of control bytes that some call so)."""
    odd = np.zeros(len(data), dtype=bool)
    odd |= (data >= 0x1C) & (data <= 0x1F)
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        odd[:-1] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    if len(data) > 2 and (data >= 0xE1).any():
        a, b, c = data[:-2], data[1:-1], data[2:]
        odd[:-2] |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        odd[:-2] |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        odd[:-2] |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        odd[:-2] |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return odd


def unit_spans(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of a block of texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, new = _CLASS[data], starts_of_texts(offsets, n)
    space = kind == 0
    cut = np.ones(n, dtype=bool)
    cut[1:] = (kind[1:] != kind[:-1]) | new[1:]
    hard = _hard_bytes(data)
    if hard.any():
        edge = np.ones(n, dtype=bool)  # where chunks and white-space runs begin
        edge[1:] = (space[1:] != space[:-1]) | new[1:]
        chunk = np.cumsum(edge) - 1
        whole = np.zeros(chunk[-1] + 1, dtype=bool)
        whole[chunk[hard]] = True
        cut &= ~whole[chunk] | edge
    if not spaced:
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        keep = ~space[starts]
        return starts[keep], ends[keep]
    follows = np.flatnonzero(space[:-1] & ~space[1:] & ~new[1:]) + 1  # text after white space
    cut[follows - 1] = True
    cut[follows[data[follows - 1] == 32]] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


class UnitEncoder:
    """One tokenizer in one process, with its cache of units."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"] or {}
        self.spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        self.dropped = pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.keys = np.zeros(1 << CACHE_BITS, dtype=np.uint64)
        self.sizes = np.full(1 << CACHE_BITS, 255, dtype=np.uint8)  # 255: nothing there
        self.rows = np.zeros((1 << CACHE_BITS, CACHED_IDS), dtype="<u4")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts go to the library as they are."""
        n = len(offsets) - 1
        if not (self.spaced or self.dropped):
            return np.ones(n, dtype=bool)
        whole = np.zeros(n, dtype=bool)
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                whole[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        if self.spaced:
            odd = np.flatnonzero(_odd_space(data))
            whole[np.searchsorted(offsets, odd, side="right") - 1] = True
        return whole

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct units' numbers of ids, these ids one after the other, and each unit's place among the distinct ones."""
        keys = hash_spans(data, starts, ends)
        order = np.argsort(keys)
        ranked = keys[order]
        lead = np.ones(len(keys), dtype=bool)
        lead[1:] = ranked[1:] != ranked[:-1]
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.cumsum(lead) - 1
        names, at = ranked[lead], order[lead]
        bits = np.uint64(len(self.keys) - 1)
        slots = [((names >> np.uint64(k)) & bits).astype(np.int64) for k in (0, 32)]
        own = [(self.keys[slot] == names) & (self.sizes[slot] != 255) for slot in slots]
        slot, hit = np.where(own[0], slots[0], slots[1]), own[0] | own[1]
        sizes = self.sizes[slot].astype(np.int64)
        missing = np.flatnonzero(~hit)
        fresh = np.zeros(0, "<u4")
        if len(missing):
            raw = data.tobytes()
            spans = zip(starts[at[missing]].tolist(), ends[at[missing]].tolist())
            found = self.encode([raw[a:b].decode() for a, b in spans])
            sizes[missing] = [len(x) for x in found]
            fresh = np.fromiter(chain.from_iterable(found), "<u4", int(sizes[missing].sum()))
        first = np.concatenate(([0], np.cumsum(sizes)))
        pool = np.empty(first[-1], dtype="<u4")
        inside = np.arange(CACHED_IDS) < sizes[hit][:, None]
        pool[expand(first[:-1][hit], sizes[hit])] = self.rows[slot[hit]][inside]
        pool[expand(first[:-1][missing], sizes[missing])] = fresh
        small = missing[sizes[missing] <= CACHED_IDS]
        if len(small):  # the first place if nothing is there, else the second
            to = np.where(self.sizes[slots[0][small]] == 255, slots[0][small], slots[1][small])
            to, which = np.unique(to, return_index=True)
            small = small[which]
            self.keys[to], self.sizes[to] = names[small], sizes[small]
            row = np.repeat(np.arange(len(small)), sizes[small])
            self.rows[to[row], np.arange(len(row)) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])] = pool[expand(first[:-1][small], sizes[small])]
        return sizes, pool, place

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text."""
        parts, counts = [], []
        for _, _, part, at in blocks(data, offsets):
            whole = self._whole(part, at)
            starts, ends = unit_spans(part, at, bool(self.spaced))
            sizes, pool, place = self._lookup(part, starts, ends)
            first = np.concatenate(([0], np.cumsum(sizes)))
            each = sizes[place]
            begin = np.concatenate(([0], np.cumsum(each)))
            out = pool[expand(first[place], each)]
            edges = begin[np.searchsorted(starts, at)]
            number = np.diff(edges)
            if whole.any():
                pieces, raw = np.split(out, edges[1:-1]), part.tobytes()
                hit = np.flatnonzero(whole)
                for k, ids in zip(hit.tolist(), self.encode([raw[at[k] : at[k + 1]].decode() for k in hit])):
                    pieces[k], number[k] = np.array(ids, dtype="<u4"), len(ids)
                out = np.concatenate(pieces)
            parts.append(out)
            counts.append(number)
        return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of ids of each text, without building them."""
        out = []
        for _, _, part, at in blocks(data, offsets):
            whole = self._whole(part, at)
            starts, ends = unit_spans(part, at, bool(self.spaced))
            sizes, _, place = self._lookup(part, starts, ends)
            sums = np.concatenate(([0], np.cumsum(sizes[place])))
            number = np.diff(sums[np.searchsorted(starts, at)])
            if whole.any():
                raw, hit = part.tobytes(), np.flatnonzero(whole)
                number[hit] = [len(ids) for ids in self.encode([raw[at[k] : at[k + 1]].decode() for k in hit])]
            out.append(number)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The process's encoder for a tokenizer file; where the machine lacks the path, its own installed file of that name."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path if os.path.exists(path) else tokenizer_files.path(os.path.basename(path)))
    return _ENCODERS[path]


def file_digest(path: str) -> str:
    """The tokenizer version: a digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()
