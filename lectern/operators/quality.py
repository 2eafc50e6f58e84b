"""Data-quality checks as one-row or violation DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import collapse

#: A caption with fewer characters goes on in the next line.
SHORT_CAPTION = 25
MERGED_CELL = r"\d+\.\d+(?:\s+\d+\.\d+){2,}"


def span_faults(spans: DataFrame, paragraphs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans out of range, or whose text isn't in their chunk: paper_id, ordinal, paragraph_id, fault."""
    text = paragraphs.select("paragraph_id", F.col("text").alias("p_text"))
    rows = spans.join(text, "paragraph_id").join(chunks.select("paper_id", "ordinal", F.col("text").alias("c_text")), ["paper_id", "ordinal"])
    cut = F.expr("substring(p_text, char_start + 1, char_end - char_start)")
    bad_range = F.expr("char_start < 0 OR char_end < char_start OR char_end > length(p_text)")
    fault = F.when(bad_range, "range").when(~F.contains(collapse(F.col("c_text")), collapse(cut)), "not contained")
    return rows.select("paper_id", "ordinal", "paragraph_id", fault.alias("fault")).where("fault IS NOT NULL")


def orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    return rows.join(owners.select(key), key, "left_anti")


def blank_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.where(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0)


def failure_rate(papers: DataFrame) -> DataFrame:
    """quarantined / all; 1 for none at all."""
    return papers.agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.count_if(F.col("status") != "ok"), F.count("*")), F.lit(1.0)).alias("rate"))


def looks_tabular(rows: Column) -> Column:
    """rows: array of arrays of cell texts. Refuses debris: too few rows, columns or filled cells."""
    cells = F.flatten(rows)
    filled = F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != "")
    columns = F.array_max(F.transform(rows, lambda r: F.size(r)))
    empty = F.filter(F.sequence(F.lit(1), F.greatest(columns, F.lit(1))), lambda i: ~F.exists(rows, lambda r: F.coalesce(F.try_element_at(r, i), F.lit("")) != ""))
    enough = (F.size(rows) >= 2) & (columns >= 2) & (2 * F.size(filled) >= F.size(cells)) & ~((F.size(rows) < 3) & (F.size(filled) < 6))
    return F.coalesce(enough & (F.size(empty) <= 0.34 * columns), F.lit(False))


def merged_cells(rows: Column) -> Column:
    """Whether a cell holds three or more decimal numbers: cells that ran together."""
    return F.exists(F.flatten(rows), lambda c: F.regexp_like(c, F.lit(MERGED_CELL)))


def huge_grid(rows: Column) -> Column:
    return (F.size(rows) > 40) | (F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)) > 12)


def largest_without_overlap(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Of a page's boxes (page_id, box_id, x0, y0, x1, y1), largest first, those that no kept one covers.

    A page's boxes are few; they are folded in one expression, without a join.
    """
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    zero = F.lit(0.0)

    def covers(a: Column, b: Column) -> Column:
        inter = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
        return F.coalesce(F.try_divide(inter, F.least(area(a), area(b))) > share, F.lit(False))

    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("box_id"))
    by_size = lambda a, b: F.when(area(a) > area(b), -1).when(area(a) < area(b), 1).when(a["box_id"] < b["box_id"], -1).otherwise(1)
    lists = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(box), by_size).alias("b"))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda held, x: F.when(F.exists(held, lambda h: covers(h, x)), held).otherwise(F.concat(held, F.array(x))))
    return lists.select("page_id", F.explode(kept).alias("k")).select("page_id", "k.box_id")


def captions_near(tables: DataFrame, lines: DataFrame, above: float = 80.0, aside: float = 40.0) -> DataFrame:
    """page_id, box_id, label, caption: the first caption line around a table.

    lines: page_id, ordinal, x0, y0, x1, y1, text.
    """
    t, n = tables.alias("t"), lines.alias("n")
    near = F.expr(f"t.page_id = n.page_id AND n.y1 >= t.y0 - {above} AND n.y0 <= t.y1 + {above} AND n.x1 >= t.x0 - {aside} AND n.x0 <= t.x1 + {aside}")
    pattern = r"^\s*(?:TABLE|Table)\s+([IVXLC]+|\d+)\b[.:]?\s*(.*)$"
    found = t.join(n, near).select("t.page_id", "t.box_id", "n.ordinal", "n.text")
    order = Window.partitionBy("page_id", "box_id").orderBy("ordinal")
    part = lambda c, k: F.trim(F.regexp_extract(c, pattern, k))
    rows = found.select("page_id", "box_id", "ordinal", part("text", 1).alias("no"), part("text", 2).alias("rest"), F.trim(F.lead("text").over(order)).alias("after")).where("no <> ''")
    # a caption usually goes on in the next line
    goes_on = (F.length("rest") < SHORT_CAPTION) & F.col("after").isNotNull() & (part("after", 1) == "")
    rows = rows.withColumn("rest", F.when(goes_on, F.trim(F.concat_ws(" ", "rest", "after"))).otherwise(F.col("rest")))
    first = rows.groupBy("page_id", "box_id").agg(F.min_by(F.struct("no", "rest"), "ordinal").alias("f"))
    return first.select("page_id", "box_id", F.concat(F.lit("Table "), F.col("f.no")).alias("label"), F.nullif("f.rest", F.lit("")).alias("caption"))


def table_grids(candidates: DataFrame, captions: DataFrame) -> DataFrame:
    """Tables of a detector's candidates: page_id, box_id, ordinal, label, caption, header, rows, row_count, col_count.

    candidates: page_id, box_id, x0, y0, x1, y1, header and rows (arrays of
    cells); captions: ``captions_near``.  Blank rows go, and so does a first
    row that repeats the header.  Of what looks like a table, the largest of
    overlapping ones stays; a body of one row needs a caption.
    """
    filled = F.filter("rows", lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))
    rows = candidates.withColumn("rows", filled).where(looks_tabular(F.col("rows")))
    repeated = (F.size("header") > 0) & F.get("rows", 0).eqNullSafe(F.col("header"))
    rows = rows.withColumn("rows", F.when(F.coalesce(repeated, F.lit(False)), F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))).where("size(rows) > 0")
    rows = rows.join(captions, ["page_id", "box_id"], "left").where("size(rows) >= 2 OR label IS NOT NULL OR caption IS NOT NULL")
    rows = rows.join(largest_without_overlap(rows), ["page_id", "box_id"], "left_semi")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    ordinal = (F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(area), "box_id")) - 1).alias("ordinal")
    return rows.select("page_id", "box_id", ordinal, "label", "caption", "header", "rows", F.size("rows").alias("row_count"), F.array_max(F.transform("rows", lambda r: F.size(r))).alias("col_count"))


def more_than_baseline(tables: DataFrame, baseline: int) -> DataFrame:
    """merged, huge, worse: tables (rows) with cells that ran together, implausibly large ones, and whether either is worse than known."""
    merged, huge = F.count_if(merged_cells(F.col("rows"))), F.count_if(huge_grid(F.col("rows")))
    return tables.agg(merged.alias("merged"), huge.alias("huge"), ((merged > baseline) | (huge > 0)).alias("worse"))


def self_edges(edges: DataFrame) -> DataFrame:
    return edges.where("dst_paper_id = src_paper_id")


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key, side (left or right). Empty where the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def quality_report(papers: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row of corpus figures: counts, shares with conditions, and medians."""
    per = paragraphs.groupBy("paper_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    rows = papers.join(per, "paper_id", "left")
    return rows.agg(
        F.count("*").alias("papers"), F.count_distinct("source").alias("sources"), F.count_if(F.col("n").isNull()).alias("without_paragraphs"), F.coalesce(F.sum("n"), F.lit(0)).alias("paragraphs"),
        F.count_if(F.col("n") >= 10).alias("long_papers"), F.median("n").alias("median_paragraphs"), F.max("chars").alias("most_chars"), F.round(F.avg((F.col("lang") == "en").cast("double")), 6).alias("share_en"),
    )


def run_checks(checks: dict[str, Callable[[], DataFrame]]) -> list[tuple[str, str, int | str]]:
    """(name, ok / violated / crashed, rows or reason) of each check; a crash is a finding and stops nothing."""
    out: list[tuple[str, str, int | str]] = []
    for name, check in checks.items():
        try:
            n = check().count()
            out.append((name, "violated" if n else "ok", n))
        except Exception as fault:  # noqa: BLE001
            out.append((name, "crashed", str(fault).split("\n")[0][:200]))
    return out
