"""Span-preserving chunks. Input rows: paper_id, section_id, paragraph_id, ordinal, text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .. import schemas

CHARS_PER_TOKEN = 4
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z(\[])")


def paragraph_chunks(paragraphs: DataFrame, chunk_tokens: int = 0) -> DataFrame:
    """One chunk a paragraph, with its whole span."""
    order = Window.partitionBy("paper_id").orderBy(F.col("section_id").asc_nulls_last(), "ordinal", "paragraph_id")
    span = F.struct("paragraph_id", F.lit(0).alias("char_start"), F.length("text").alias("char_end"))
    return paragraphs.select("paper_id", "section_id", (F.row_number().over(order) - 1).alias("ordinal"), "text", F.array(span).alias("spans"), F.lit("paragraph").alias("strategy"))


def pieces(text: str, budget: int) -> list[tuple[int, int]]:
    """Offsets of what a paragraph is packed as: whole, else sentences, else runs cut at spaces."""
    if len(text) <= budget:
        return [(0, len(text))]
    out, edges = [], [0, *(x for m in _SENTENCE_END.finditer(text) for x in m.span()), len(text)]
    for begin, end in zip(edges[::2], edges[1::2]):
        begin += len(text[begin:end]) - len(text[begin:end].lstrip())
        end = begin + len(text[begin:end].rstrip())
        while end - begin > budget:
            cut = text.rfind(" ", begin + 1, begin + budget)
            cut = cut if cut > 0 else begin + budget
            out.append((begin, cut))
            begin = cut + (text[cut : cut + 1] == " ")
        if end > begin:
            out.append((begin, end))
    return out


def _end_of_chunk(begin: int, used: int, needs: list[int], sizes: list[int], budget: int) -> int:
    """The first piece that a chunk from ``begin`` doesn't take, where ``used`` characters are spent; it takes one at least."""
    used, at = used + sizes[begin], begin + 1
    while at < len(sizes) and (not used or used + needs[at] <= budget):
        used, at = used + sizes[at], at + 1
    return at


def pack(paragraphs: Iterable[tuple[int, str]], budget: int, overlap: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Greedy chunks (text, spans) of paragraphs (id, text) in order.

    All pieces are laid out first; a chunk is a run of them.  The budget counts
    the characters of the pieces, not the spaces that join them, and the first
    piece of a paragraph needs room for the whole paragraph: one beyond the
    budget starts a chunk of its own, and its last piece stays open for what
    follows.  With an overlap, a chunk begins with the last characters of the
    one before, which carry no spans.
    """
    laid = [(key, text, b, e, e - b if k else len(text)) for key, text in paragraphs for k, (b, e) in enumerate(pieces(text, budget))]
    needs, sizes = [x[4] for x in laid], [e - b for _, _, b, e, _ in laid]
    chunks: list[tuple[str, list[tuple[int, int, int]]]] = []
    begin, tail = 0, ""
    while begin < len(laid):
        end = _end_of_chunk(begin, len(tail), needs, sizes, budget)
        own = laid[begin:end]
        text = " ".join(([tail] if tail else []) + [t[b:e] for _, t, b, e, _ in own])
        chunks.append((text, [(key, b, e) for key, _, b, e, _ in own]))
        begin, tail = end, text[-overlap:] if overlap else ""
    return chunks


def _packed(strategy: str, budget: int, overlap: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["section_id"] is None, r["section_id"] or 0, r["ordinal"], r["paragraph_id"]))
        parts: dict = {}
        for row in rows:
            parts.setdefault(row["section_id"] if strategy == "section" else None, []).append((row["paragraph_id"], row["text"]))
        out = [(section, text, spans) for section, part in parts.items() for text, spans in pack(part, budget, overlap)]
        named = [[{"paragraph_id": p, "char_start": b, "char_end": e} for p, b, e in spans] for _, _, spans in out]
        n = len(out)
        return pa.table({
            "paper_id": pa.array([rows[0]["paper_id"]] * n, pa.int64()), "section_id": pa.array([s for s, _, _ in out], pa.int64()), "ordinal": pa.array(range(n), pa.int32()), "text": pa.array([t for _, t, _ in out], pa.string()),
            "spans": pa.array(named, pa.list_(pa.struct([("paragraph_id", pa.int64()), ("char_start", pa.int32()), ("char_end", pa.int32())]))), "strategy": pa.array([strategy] * n, pa.string()),
        })

    return run


def flat_chunks(paragraphs: DataFrame, chunk_tokens: int = 512, overlap_tokens: int = 0) -> DataFrame:
    """Chunks of about ``chunk_tokens`` across sections. A paper is the unit of work and of order."""
    run = _packed("flat", chunk_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN)
    return paragraphs.groupBy("paper_id").applyInArrow(run, schemas.CHUNK)


def section_chunks(paragraphs: DataFrame, chunk_tokens: int = 512) -> DataFrame:
    """Chunks that don't cross sections; ordinals run through the paper."""
    return paragraphs.groupBy("paper_id").applyInArrow(_packed("section", chunk_tokens * CHARS_PER_TOKEN, 0), schemas.CHUNK)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"flat": flat_chunks, "section": section_chunks, "paragraph": paragraph_chunks}


def build_chunks(paragraphs: DataFrame, strategy: str, fingerprint: str, chunk_tokens: int = 512) -> DataFrame:
    """Chunks of a configuration, with stable ids from fingerprint, paper and ordinal."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no chunking strategy {strategy!r}")
    made = STRATEGIES[strategy](paragraphs, chunk_tokens=chunk_tokens)
    return made.select(F.xxhash64(F.lit(fingerprint), "paper_id", "ordinal").alias("chunk_id"), F.lit(fingerprint).alias("config_fingerprint"), "*")


def spans_of(chunks: DataFrame) -> DataFrame:
    """One row a span."""
    return chunks.select("paper_id", "ordinal", F.explode("spans").alias("s")).select("paper_id", "ordinal", "s.*")


def parent_sections(hits: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Small to big: for hits with section_id, the section's whole text."""
    order = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    text = paragraphs.groupBy("section_id").agg(F.array_join(order["text"], " ").alias("section_text"))
    return hits.join(text, "section_id", "left")
