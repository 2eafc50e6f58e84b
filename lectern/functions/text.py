"""Scalar text functions as columns; Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Identifier patterns.
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
ARXIV = r"(?i)arXiv[:\s]*(\d{4}\.\d{4,5})"
YEAR = r"\b(?:19|20)\d{2}\b"
TITLE_END = ",.;\"'”’)]"
MIN_TITLE_TOKENS, LONG_TITLE_TOKENS = 4, 8


def slug(title: Column) -> Column:
    """Lower case, no leading number, runs of other signs as hyphens, 80 characters at most."""
    bare = F.regexp_replace(title, r"^\s*\d+\s*[.)_-]\s*", "")
    return F.trim(F.left(F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(80)), F.lit("-"))


def title_key(title: Column) -> Column:
    """The first eight words of the slug."""
    return F.substring_index(slug(title), "-", 8)


def stem_of_path(path: Column) -> Column:
    """A file's name without folder and last ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def loose_title(title: Column) -> Column:
    """Lower-case letters and digits with single spaces; accents are not folded."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def doi_key(doi: Column) -> Column:
    return F.rtrim(F.trim(F.lower(doi)), F.lit("."))


def arxiv_key(value: Column) -> Column:
    """The bare number; version and category are not identity."""
    found = F.regexp_extract(value, r"(\d{4}\.\d{4,5})", 1)
    return F.when(found != "", found).otherwise(F.trim(F.lower(value)))


def find_doi(text: Column) -> Column:
    found = F.regexp_extract(text, DOI, 0)
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def find_arxiv(text: Column) -> Column:
    found = F.regexp_extract(text, ARXIV, 1)
    return F.when(found != "", found)


def latest_year(text: Column, limit: int = 2030) -> Column:
    """The latest year up to ``limit``; null without one."""
    years = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y <= limit))


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def or_query(text: Column) -> Column:
    """The terms as an any-of query string."""
    return F.array_join(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), " | ")


def sentences(text: Column) -> Column:
    """Splits after . ! ? before white space and a capital, an opening bracket or parenthesis."""
    parts = F.transform(F.split(text, r"(?<=[.!?])(?U)\s+(?=[A-Z(\[])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def clean_cell(cell: Column) -> Column:
    """A table cell without private-use signs and NULs, white space collapsed; null is empty."""
    return F.coalesce(collapse(F.regexp_replace(cell, "[\\x{E000}-\\x{F8FF}\\x00]", "")), F.lit(""))


def clean_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def nul_free(text: Column) -> Column:
    """Without NULs; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"\x00", ""), F.lit(""))


def dehyphenate(text: Column) -> Column:
    """Joins words cut at a line's end and collapses white space; under two characters is null."""
    joined = collapse(F.regexp_replace(text, r"(?U)(\w)-\s+(\w)", "$1$2"))
    return F.when(F.length(joined) >= 2, joined)


def section_kind(heading: Column) -> Column:
    """abstract, references, acknowledgements or body; null for an empty heading."""
    bare = F.regexp_replace(F.lower(heading), r"^[\s.:\d]+", "")
    bare = F.regexp_replace(bare, r"^[ivxlc]+[.)]?\s+", "")
    kinds = F.when(F.startswith(bare, F.lit("abstract")), "abstract").when(F.startswith(bare, F.lit("reference")), "references")
    return F.when(F.length(F.coalesce(heading, F.lit(""))) > 0, kinds.when(F.startswith(bare, F.lit("acknowled")), "acknowledgements").otherwise("body"))


def heading_depth(number: Column, most: int | None = None) -> Column:
    """The dots of a section number; at most ``most``."""
    dots = F.length(number) - F.length(F.regexp_replace(number, r"\.", ""))
    dots = F.coalesce(dots, F.lit(0))
    return F.least(dots, F.lit(most)) if most is not None else dots


def plausible_title(title: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(title), r"\s+"), lambda w: w != ""))
    fits = words.between(3, 30) & F.length(title).between(15, 250) & ~F.endswith(F.trim(title), F.lit("."))
    return F.coalesce(fits, F.lit(False))


def thin_extraction(chars: Column, pages: Column, least: int = 1200) -> Column:
    """Fewer characters a page than prose has; false without a page count."""
    return F.coalesce((pages > 0) & (F.try_divide(chars, pages) < least), F.lit(False))


def fold(text: str) -> str:
    """Accents stripped, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def phrase(text: str) -> str:
    """Folded words of letters and digits, single spaces."""
    return " ".join(re.sub(r"[^a-z0-9 ]+", " ", fold(text)).split())


def reference_phrase(text: str) -> str:
    """Folded text that keeps what may end a title; cut words are joined, other hyphens are spaces."""
    kept = re.sub(r"[^a-z0-9\s\-" + re.escape(TITLE_END) + "]+", " ", fold(text))
    return " ".join(re.sub(r"(\w)-\s+(\w)", r"\1\2", kept).replace("-", " ").split())


def _by_value(one):
    """An Arrow UDF body that applies ``one`` to each value that isn't null."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x) for x in column.to_pylist()], pa.string())

    return run


phrase_udf = F.arrow_udf(_by_value(phrase), T.StringType())
reference_phrase_udf = F.arrow_udf(_by_value(reference_phrase), T.StringType())


def title_matches(title: Column, reference: Column) -> Column:
    """Whether a title's phrase is in a reference's phrase, up to a place where titles end.

    title: ``phrase_udf``; reference: ``reference_phrase_udf``.  Under four
    words nothing matches; from eight words the last two may be missing.
    """
    words = F.split(title, " ")
    n = F.size(words)
    end = "(?:$|\\s*[" + re.sub(r"([\]\"'])", r"\\\1", TITLE_END) + "])"
    whole = F.regexp_like(reference, F.concat(F.lit("\\Q"), title, F.lit("\\E" + end)))
    most = F.array_join(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(1))), " ")
    return (n >= MIN_TITLE_TOKENS) & (whole | ((n >= LONG_TITLE_TOKENS) & F.contains(reference, most)))
