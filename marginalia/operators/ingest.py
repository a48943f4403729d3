"""Blocks with provenance, from decoded text blocks or layout items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import judgement as J
from ..functions import text as T

HEADING_RATIO, HEADING_CHARS, BODY_CHARS, BODY_SIZE = 1.12, 120, 80, 10.0
SKIPPED, HEADINGS, LISTS = ["page_header", "page_footer", "footnote"], ["section_header", "title"], ["list_item"]


def span_text(lines: Column) -> Column:
    """Text of ``array<array<struct<text, size>>>``: spans of a line joined, lines by a space, runs of blanks collapsed."""
    joined = F.transform(lines, lambda spans: F.trim(F.array_join(F.transform(spans, lambda s: s["text"]), "")))
    return F.trim(F.regexp_replace(F.array_join(F.filter(joined, lambda x: x != ""), " "), r"[ \t]+", " "))


def span_size(lines: Column) -> Column:
    """The largest span of a block."""
    return F.coalesce(F.array_max(F.transform(F.flatten(lines), lambda s: s["size"])), F.lit(0.0))


def text_blocks(raw: DataFrame) -> DataFrame:
    """Decoded blocks that carry text, boxes rounded."""
    b = F.col("bbox")
    rows = raw.where("coalesce(type, 0) = 0 and text <> ''")
    return rows.withColumn("bbox", G.box(*(F.round(b[k], 2) for k in ("x0", "y0", "x1", "y1"))))


def body_size(raw: DataFrame) -> DataFrame:
    """(paper, body): the median size of long blocks, by which headings are told."""
    long = F.median(F.when(F.length("text") > BODY_CHARS, F.col("size")))
    return raw.groupBy("paper").agg(F.coalesce(long, F.lit(BODY_SIZE)).alias("body"))


def is_heading(size: Column, body: Column, text: Column) -> Column:
    return (size > body * HEADING_RATIO) & (F.length(text) <= HEADING_CHARS)


def _with_ids(rows: DataFrame, by: Sequence[str] = ("seq",)) -> DataFrame:
    """Ids and heading paths in document order; one sort of each paper."""
    order = Window.partitionBy("paper").orderBy(*by)
    last = F.last(F.when(F.col("opens"), F.col("heading")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    path = F.when(last.isNull(), F.array().cast("array<string>")).otherwise(F.array(last))
    return rows.withColumn("heading_path", path)


def _numbered(rows: DataFrame, by: Sequence[str] = ("seq",)) -> DataFrame:
    order = Window.partitionBy("paper").orderBy(*by)
    rows = rows.withColumn("id", F.format_string("block_%04d", F.row_number().over(order)))
    return rows.select("paper", "seq", "id", "type", "page", "bbox", "heading_path", "text")


def flat_blocks(raw: DataFrame, by: Sequence[str] = ("seq",)) -> DataFrame:
    """Blocks of the flat reader's raw blocks (paper, seq, type, page, bbox, text, size).

    by: columns whose order is that of ``seq``; rows that lie by paper and sorted by these are not sorted again.
    """
    rows = text_blocks(raw)
    # the body size is a window over the paper, whose sort the ids need anyway: no join
    long = F.median(F.when(F.length("text") > BODY_CHARS, F.col("size"))).over(Window.partitionBy("paper"))
    rows = rows.withColumn("opens", is_heading(F.col("size"), F.coalesce(long, F.lit(BODY_SIZE)), F.col("text")))
    rows = rows.withColumn("type", F.when(F.col("opens"), "sectionheader").otherwise("text")).withColumn("heading", F.col("text"))
    return _numbered(_with_ids(rows, by), by)


def provenance_page(pages: Column) -> Column:
    """The page that an item stands on: the first of its provenance that is known, null where none is."""
    return F.get(F.filter(pages, lambda x: x.isNotNull()), F.lit(0))


def layout_label(label: Column) -> Column:
    return F.lower(F.substring_index(F.coalesce(label, F.lit("text")), ".", -1))


def layout_blocks(items: DataFrame) -> DataFrame:
    """Blocks of layout items (paper, seq, label, kind, text, table_md, caption, page_no, page_height, l, t, r, b, coord_origin).

    A heading without text still resets the heading path, and a list item
    without text is a block of its bullet.
    """
    label, kind = layout_label(F.col("label")), F.lower(F.coalesce("kind", F.lit("")))
    rows = items.where(~label.isin(SKIPPED) & F.col("page_no").isNotNull())
    plain, caption = T.squeeze(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("caption", F.lit("")))
    table, picture = F.contains(kind, F.lit("table")), F.contains(kind, F.lit("picture"))
    type_ = F.when(table, "table").when(picture, "picture").when(label.isin(HEADINGS), "sectionheader").when(label.isin(LISTS), "list").otherwise("text")
    grid = F.trim(F.coalesce("table_md", F.lit("")))
    shown = (
        F.when(table, F.when(caption != "", F.concat(F.lit("**"), caption, F.lit("**\n\n"), grid)).otherwise(grid))
        .when(picture, F.when(caption != "", F.concat(F.lit("[FIGURE: "), caption, F.lit("]"))).otherwise("[FIGURE]"))
        .when(label.isin(LISTS), F.concat(F.lit("- "), plain))
        .otherwise(plain)
    )
    bbox = G.to_top_left(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.col("coord_origin"), F.col("page_height"))
    rows = rows.select("paper", "seq", F.col("page_no").alias("page"), bbox.alias("bbox"), type_.alias("type"), shown.alias("text"))
    rows = rows.withColumn("opens", F.col("type") == "sectionheader").withColumn("heading", F.col("text"))
    return _numbered(_with_ids(rows).where("text <> ''"))


def rendered(annotated: bool) -> Column:
    """Markdown of one block, with its marker or without."""
    mark = F.concat(F.lit("  <!-- "), F.col("id"), F.lit(", page "), F.col("page").cast("string"), F.lit(" -->")) if annotated else F.lit("")
    above = F.concat(F.lit("<!-- "), F.col("id"), F.lit(", page "), F.col("page").cast("string"), F.lit(", table -->\n")) if annotated else F.lit("")
    return (
        F.when(F.col("type") == "sectionheader", F.concat(F.lit("## "), F.col("text"), mark, F.lit("\n")))
        .when(F.col("type") == "table", F.concat(above, F.col("text"), F.lit("\n")))
        .otherwise(F.concat(F.col("text"), mark, F.lit("\n")))
    )


def markdown(blocks: DataFrame) -> DataFrame:
    """(paper, clean_md, annotated_md): one entry a block, in order."""
    rows = blocks.select("paper", "seq", rendered(False).alias("clean"), rendered(True).alias("annotated"))
    whole = rows.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("seq", "clean", "annotated"))).alias("rows"))
    return whole.select("paper", F.array_join("rows.clean", "\n").alias("clean_md"), F.array_join("rows.annotated", "\n").alias("annotated_md"))


def type_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("paper").agg(*J.counts(F.col("type"), J.BLOCK_TYPES))


def paper_title(blocks: DataFrame) -> DataFrame:
    """(paper, title): the first heading of 15 characters, else the first text of 25."""
    n = F.length(F.trim("text"))
    rank = F.when((F.col("type") == "sectionheader") & (n >= 15), 0).when((F.col("type") == "text") & (n >= 25), 1)
    best = F.min_by("text", F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("seq"))))
    return blocks.groupBy("paper").agg(F.left(T.squeeze(F.coalesce(best, F.lit(""))), F.lit(T.TITLE_CHARS)).alias("title"))


def first_page(blocks: DataFrame) -> DataFrame:
    """(paper, first_page): the text of page 1."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return blocks.where("page = 1").groupBy("paper").agg(rows.alias("r")).select("paper", F.array_join("r.text", "\n").alias("first_page"))
