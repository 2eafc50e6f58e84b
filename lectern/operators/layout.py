"""Structure from the lines of a page layout: doc_id, pos, text, size, bold, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import collapse, dehyphenate, find_arxiv, find_doi, latest_year, section_kind

# Headings that papers share, numbered headings, and the stamp in the margin.
KNOWN_HEADINGS = (
    "abstract", "introduction", "related work", "background", "system model", "methodology", "method", "experiments", "experimental results", "results",
    "evaluation", "discussion", "conclusion", "conclusions", "references", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements",
)
NUMBERED = r"^\s*(\d+(?:\.\d+)*|[IVXLC]+)[.)]?\s+\S"
STAMP = r"(?i)^\s*arXiv:\s*\d{4}\.\d{4,5}"
INLINE_ABSTRACT = r"(?i)^\s*abstract\s*[-–—:]{0,2}\s*"
# Venue forms, in order of trust.
VENUES = (
    r"(?i)\bIEEE\s+(?:/\w+\s+)?TRANSACTIONS\s+ON\s+[A-Z][A-Z\s,&-]{4,60}", r"(?i)\bIEEE\s+(?:COMMUNICATIONS\s+)?(?:SURVEYS?\s*&?\s*TUTORIALS?)",
    r"(?i)\bIEEE\s+(?:JOURNAL|ACCESS|NETWORK|WIRELESS\s+COMMUNICATIONS(?:\s+LETTERS)?)[A-Z\s,&-]{0,40}", r"\bIEEE\s+[A-Z][a-zA-Z]*\s+Magazine\b",
    r"\bProc(?:eedings)?\.?\s+(?:of\s+)?(?:the\s+)?[A-Z][\w\s.&-]{4,50}", r"\bEntropy\b", r"(?i)\barXiv\s+preprint\b",
)


def is_heading(text: Column, size: Column, body: Column, bold: Column) -> Column:
    """Short, and a known name, large, numbered in bold, or a phrase in capitals."""
    t = F.trim(text)
    numbered = F.regexp_like(t, F.lit(NUMBERED))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"^(?:\d+(?:\.\d+)*|[ivxlc]+)[.)]?\s+", ""), r"[\s.:]+$", ""))
    capitals = F.length(t).between(8, 60) & (F.upper(t) == t) & (F.lower(t) != t) & (F.size(F.split(t, r"\s+")) >= 2) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 6)
    short = F.length(t).between(2, 120) & ~(F.regexp_like(t, F.lit("[.,;]$")) & ~numbered) & ~F.regexp_like(t, F.lit(STAMP))
    return short & (bare.isin(*KNOWN_HEADINGS) | (size > body * 1.12) | (bold & (size >= body * 0.98) & numbered) | capitals)


def sectioned(lines: DataFrame) -> DataFrame:
    """lines with section (0 before the first heading), heading flag and kind."""
    per = lines.groupBy("doc_id").agg(F.median("size").alias("body"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.join(per, "doc_id").withColumn("is_heading", is_heading(F.col("text"), F.col("size"), F.col("body"), F.col("bold")))
    rows = rows.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("body")


def sections(lines: DataFrame) -> DataFrame:
    """doc_id, section, heading, kind, text, page_from, page_to; text in order, cut words joined."""
    rows = sectioned(lines)
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "text"))))
    out = rows.groupBy("doc_id", "section").agg(F.max(F.when(F.col("is_heading"), F.col("text"))).alias("heading"), body.alias("b"), F.min("page").alias("page_from"), F.max("page").alias("page_to"))
    return out.select("doc_id", "section", "heading", section_kind(F.col("heading")).alias("kind"), dehyphenate(F.array_join(F.col("b.text"), " ")).alias("text"), "page_from", "page_to")


def front_matter(lines: DataFrame) -> DataFrame:
    """doc_id, title, venue, year, doi, arxiv_id from the first page."""
    first = lines.where("page = 1")
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], " ")
    head = first.groupBy("doc_id").agg(joined.alias("head"))
    bands = first.where(~F.regexp_like("text", F.lit(STAMP))).groupBy("doc_id", F.round("size", 1).alias("band")).agg(joined.alias("line"))
    line = F.regexp_replace(F.trim(F.regexp_replace("line", r"\s+", " ")), r"^[a-z]\s+(?=[A-Z])", "")
    bands = bands.select("doc_id", "band", line.alias("line")).where((F.length("line") >= 15) & (F.size(F.split("line", " ")) >= 3) & ~F.regexp_like("line", F.lit(INLINE_ABSTRACT)))
    titles = bands.groupBy("doc_id").agg(F.left(F.max_by("line", "band"), F.lit(400)).alias("title"))
    return head.join(titles, "doc_id", "left").select("doc_id", "title", venue(F.col("head")).alias("venue"), latest_year(F.col("head")).alias("year"), find_doi(F.col("head")).alias("doi"), find_arxiv(F.col("head")).alias("arxiv_id"))


# What ends a venue, the signs around it, its length, and where a stamp counts.
VENUE_TAIL, VENUE_SIGNS = r"(?s)(?:,?\s+VOL\.|,?\s+NO\.|\s+\d{4}\b).*$", r"^[ ,.;:-]+|[ ,.;:-]+$"
VENUE_LENGTH, STAMP_WITHIN = (4, 80), 400


def venue(head: Column) -> Column:
    """The first plausible venue of a running header; a stamped page is an arXiv preprint; else null."""
    found = F.array(*[F.regexp_extract(head, pattern, 0) for pattern in VENUES])
    bare = F.transform(found, lambda v: F.regexp_replace(F.regexp_replace(collapse(v), VENUE_TAIL, ""), VENUE_SIGNS, ""))
    plausible = F.filter(bare, lambda v: F.length(v).between(*VENUE_LENGTH))
    stamped = F.regexp_like(head, F.lit(STAMP)) | F.contains(F.lower(F.left(head, F.lit(STAMP_WITHIN))), F.lit("arxiv"))
    return F.coalesce(F.get(plausible, 0), F.when(stamped, F.lit("arXiv preprint")))


def page_counts(lines: DataFrame) -> DataFrame:
    """doc_id, page_count of layout lines."""
    return lines.groupBy("doc_id").agg(F.max("page").alias("page_count"))


def inline_abstract(paragraph: Column) -> Column:
    """The text of a paragraph that begins with "Abstract", up to the index terms; null for others."""
    text = F.regexp_replace(paragraph, INLINE_ABSTRACT, "")
    text = F.trim(F.regexp_replace(text, r"(?is)\b(?:index terms|keywords)\s*[-–—:].*$", ""))
    return F.when(F.regexp_like(paragraph, F.lit(INLINE_ABSTRACT)), F.nullif(text, F.lit("")))


def abstracts(paragraphs: DataFrame, within: int = 8) -> DataFrame:
    """doc_id, abstract: of a section of that kind, else inline within the first paragraphs.

    paragraphs: doc_id, pos (from 0), kind, text.
    """
    own = F.when(F.col("kind") == "abstract", F.col("text"))
    inline = F.when(F.col("pos") < within, inline_abstract(F.col("text")))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("pos")))
    return paragraphs.groupBy("doc_id").agg(F.coalesce(first(own), first(inline)).alias("abstract"))


def split_references(text: Column) -> Column:
    """Entries after ``[n]`` marks; without marks, the lines longer than 20 characters. 2,000 characters at most each."""
    flat = F.regexp_replace(text, "\n", " ")
    marked = F.transform(F.slice(F.split(flat, r"\s*\[\d{1,3}\]\s*"), F.lit(2), F.lit(2_000_000)), lambda x: F.trim(x))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 20)
    entries = F.when(F.size(marked) > 0, marked).otherwise(lines)
    return F.transform(F.filter(entries, lambda x: x != ""), lambda x: F.left(x, F.lit(2000)))


def references(sections: DataFrame) -> DataFrame:
    """doc_id, ordinal, raw, doi, arxiv_id of reference sections (doc_id, text)."""
    rows = sections.select("doc_id", F.posexplode(split_references(F.col("text"))).alias("ordinal", "raw"))
    return rows.select("doc_id", "ordinal", "raw", find_doi(F.col("raw")).alias("doi"), find_arxiv(F.col("raw")).alias("arxiv_id"))
