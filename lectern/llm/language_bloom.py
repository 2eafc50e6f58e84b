"""Language identification with bit-sliced Bloom filters of byte n-grams.

An array of bit masks is the filter of up to WORD languages at once: slot by
slot, bit l tells whether language l's filter has that slot.  More languages
take more arrays.  The masks of an n-gram's slots, and-ed, give all languages
that contain it.  Over a text, the
bits are counted per language, corrected for the filter's false positives, and
the language with most n-grams decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .textbytes import blocks, starts_of_texts, text_buffer

SIZES, HASHES, SLOT_BITS, WORD = (4, 6), 3, 21, 63
#: n-grams that a task of the training counts at once.
FLUSH = 1 << 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[65:91] += 32
_SPACE[[k for k in range(128) if not (65 <= k < 91 or 97 <= k < 123)]] = 32


def _folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, everything else in ASCII as a space."""
    out = _SPACE[data]
    if len(data) > 1:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[upper] += 0x20
    return out


def _grams(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and packed bytes of the n-grams whose second byte is a letter's and that lie in one text."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = data[1 : n + 1] != 32
    new = starts_of_texts(offsets, len(data))
    for k in range(1, size):
        ok &= ~new[k : k + n]
    at = np.flatnonzero(ok)
    value = np.full(len(at), size, dtype=np.uint64)
    for k in range(size):
        value = (value << np.uint64(8)) | data[at + k]
    return at, value


def _slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    h = grams * np.uint64(_MULTIPLIERS[0])
    h ^= h >> np.uint64(31)
    return [(h * np.uint64(m)) >> np.uint64(64 - bits) for m in _MULTIPLIERS[:HASHES]]


@dataclass
class LanguageFilter:
    """The filter: languages in order, masks by slot (a row for each WORD languages), and each language's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    rate: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.masks = self.masks.reshape(-1, self.masks.shape[-1])
        if len(self.languages) > WORD * len(self.masks):
            raise ValueError("there are more languages than bits")
        fill = np.array([np.mean((self.masks[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)) for k in range(len(self.languages))])
        self.rate = fill**HASHES

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the number of n-grams, and the corrected number in each language."""
        n_texts, k = len(offsets) - 1, len(self.languages)
        total, hits = np.zeros(n_texts), np.zeros((n_texts, k))
        bits = int(self.masks.shape[1] - 1).bit_length()
        for first, end, part, at in blocks(data, offsets):
            part = _folded(part)
            for size in SIZES:
                where, grams = _grams(part, at, size)
                slots, edge = _slots(grams, bits), np.searchsorted(where, at)
                total[first:end] += np.diff(edge)
                for word, masks in enumerate(self.masks):
                    mask = masks[slots[0]]
                    for slot in slots[1:]:
                        mask &= masks[slot]
                    for lang in range(word * WORD, min(k, (word + 1) * WORD)):
                        sums = np.concatenate(([0], np.cumsum((mask >> np.uint64(lang % WORD)) & np.uint64(1), dtype=np.int64)))
                        hits[first:end, lang] += np.diff(sums[edge])
        clean = np.maximum(hits - total[:, None] * self.rate, 0) / np.maximum(1 - self.rate, 1e-9)
        return total, clean


def _train_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): in how many of some texts a language's n-gram occurs."""
    seen: dict[str, list[np.ndarray]] = {}
    held = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, parts in seen.items():
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        seen.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offsets = text_buffer(batch.column(1))
        for first, end, part, at in blocks(data, offsets):
            part = _folded(part)
            found = [_grams(part, at, size) for size in SIZES]
            edges = [np.searchsorted(where, at) for where, _ in found]
            for k in range(end - first):
                for (_, grams), edge in zip(found, edges):
                    own = np.unique(grams[edge[k] : edge[k + 1]])
                    seen.setdefault(langs[first + k], []).append(own)
                    held += len(own)
            if held >= FLUSH:
                yield from counted()
                held = 0
    yield from counted()


def _to_slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy().view(np.uint64)
            slots = np.concatenate(_slots(grams, bits)).astype(np.int64)
            word, mask = (pa.array(np.tile(batch.column(k).to_numpy(), HASHES)) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(slots), word, mask], names=["slot", "word", "mask"])

    return run


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int | None = 3000, min_docs: int = 3, slot_bits: int = SLOT_BITS) -> LanguageFilter:
    """Learn the filter from labelled rows.

    sample: about this many rows per language are read, those with the least
    hashed ids; it bounds the model's training.  None: all rows are.  An n-gram
    enters a language's filter if at least ``min_docs`` of them contain it
    (fewer where the language has fewer rows; one in a thousand of them where
    that is more and all are read).  Rows with a null text or label are left out.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1 << slot_bits), dtype=np.uint64))
    few = lambda n: max(min(min_docs, max(1, n // 10)), n // 1000 if sample is None else 0)
    least = F.create_map(*[F.lit(x) for name in languages for x in (name, few(sizes[name]))])
    bit = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, 1 << k % WORD)])
    word = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k // WORD)])
    if sample is not None:
        share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample / sizes[name]) * (1 << 30))])
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) < share[F.col(lang_col)])
    grams = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_train_grams, "lang string, gram bigint, n bigint")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("lang")])
    slots = grams.select("gram", word[F.col("lang")].alias("word"), bit[F.col("lang")].cast("bigint").alias("mask")).mapInArrow(_to_slots(slot_bits), "slot bigint, word int, mask bigint")
    table = slots.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2 ** slot_bits rows for each WORD languages
    masks = np.zeros((1 + (len(languages) - 1) // WORD, 1 << slot_bits), dtype=np.uint64)
    masks[table["word"].to_numpy(), table["slot"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return LanguageFilter(languages, masks)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            total, clean = model.counts(*text_buffer(batch.column(1)))
            letters = pc.match_substring_regex(pc.fill_null(batch.column(1), ""), r"\pL").to_numpy(zero_copy_only=False)
            if not model.languages:
                letters[:] = False
                best, most, every = np.zeros(len(total), np.int64), np.zeros(len(total)), np.ones(len(total))
            else:
                best = clean.argmax(axis=1)
                most, every = clean.max(axis=1), clean.sum(axis=1)
            names = [model.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())]
            score = np.where(letters & (every > 0), most / np.maximum(every, 1e-9), 0.0)
            share = np.where(letters, (most + 2) / (total + 2), 0.0)
            found = [pa.array(names, pa.string()), pa.array(score), pa.array(np.minimum(share, 1.0))]
            kept = [batch.column(0), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[f"k{k}" for k in range(len(kept))] + ["lang_pred", "score", "coverage"])

    return run


def identify(docs: DataFrame, model: LanguageFilter, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns to keep, lang_pred, score, coverage.

    lang_pred is ``und`` for a null text and one without a letter, else the
    language with most n-grams (the first by name among equals, also for texts
    too short for one).  score is its share of all languages' n-grams,
    coverage its share of the text's, with two more counted as its own, so that
    a short text isn't taken for an unknown language.  Whole texts are read.  Ids may be null
    or repeat, and other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *keep]
    rows = docs.select(F.col(id_col).alias("k0"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep, 1)])
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"k{k} {kinds[f'k{k}']}" for k in range(len(names))) + ", lang_pred string, score double, coverage double"
    out = rows.mapInArrow(_predict(shared), schema)
    return out.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(names)], "lang_pred", "score", "coverage")


def thresholds(labelled: DataFrame, model: LanguageFilter, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.01, share: float = 0.5) -> dict[str, float]:
    """The coverage that a text of each language needs: ``share`` of a low quantile of labelled rows' coverage.

    labelled: rows that the model hasn't learnt from; all of them are read, and
    those that are identified as labelled count.
    """
    rows = labelled.where(F.col(lang_col).isin(model.languages) & F.col(text_col).isNotNull())
    own = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    right = identify(own, model, keep=("label",)).where("lang_pred = label")
    return {r[0]: share * r[1] for r in right.groupBy("label").agg(F.percentile_approx("coverage", quantile, 10000)).collect()}


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
