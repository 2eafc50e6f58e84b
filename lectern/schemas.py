"""Row types of the corpus model. Readers get them explicitly; nothing is inferred."""

from __future__ import annotations

REFERENCE = "struct<raw:string,ordinal:int,doi:string,arxiv_id:string,title:string>"
PARAGRAPH = "struct<text:string,ordinal:int,page_from:int,page_to:int>"
SECTION = f"struct<heading:string,ordinal:int,depth:int,kind:string,paragraphs:array<{PARAGRAPH}>>"
GRID = "struct<header:array<string>,rows:array<array<string>>,col_count:int,row_count:int,bbox:array<double>,detector:string>"
TABLE = f"struct<ordinal:int,label:string,caption:string,page:int,grid:{GRID}>"

#: One parsed document, nested; the corpus tables are explosions of it.
PAPER = (
    "external_id string, parser string, title string, abstract string, year int, venue string, doi string, arxiv_id string, page_count int, "
    f"sections array<{SECTION}>, `tables` array<{TABLE}>, `references` array<{REFERENCE}>"
)
SPAN = "struct<paragraph_id:bigint,char_start:int,char_end:int>"
CHUNK = f"paper_id bigint, section_id bigint, ordinal int, text string, spans array<{SPAN}>, strategy string"
GOLD = "struct<paper_external_id:string,paragraph_id:bigint,char_start:int,char_end:int,quote:string,relevance:double>"
QUESTION = f"id string, question string, type string, answer string, spans array<{GOLD}>, notes string"
MANIFEST = "external_id string, filename string, sha256 string, size_bytes bigint"
EXCLUSION = "sha256 string, was_named string, reason string, decision string, date string"
EMPTY_ABSENCE = ("not_reported", "not_applicable", "unclear")
