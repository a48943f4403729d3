"""Boxes that meet on a page: a spatial join on grid cells.

Each box is laid on the cells of a grid that it touches, boxes of one page and
cell are joined on that, and the exact test decides.  A pair that shares several
cells is taken in one alone, that of the corner where their overlap begins, so
no pair comes twice and none has to be made distinct.

A box that ends before it begins, or lacks a side, meets nothing; boxes that
only touch don't overlap.  What lies beyond LIMIT counts into the outermost
cells, so that no box has more than some thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a cell in points; a usual page has some forty.
CELL, LIMIT = 120.0, 4800.0
PAGE = ["paper", "slug", "page"]


def _cell(x: Column) -> Column:
    return F.floor(F.least(F.greatest(x, F.lit(-LIMIT)), F.lit(LIMIT)) / CELL)


def on_cells(boxes: DataFrame) -> DataFrame:
    """Boxes (paper, slug, page, box, …), a row for each cell ``cx, cy`` that they touch."""
    b = F.col("box")
    rows = boxes.where((b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"]))
    rows = rows.withColumn("cx", F.explode(F.sequence(_cell(b["x0"]), _cell(b["x1"]))))
    return rows.withColumn("cy", F.explode(F.sequence(_cell(b["y0"]), _cell(b["y1"]))))


def overlaps(one: DataFrame, other: DataFrame) -> DataFrame:
    """(paper, slug, page, a, b) of boxes that overlap on a page; both: paper, slug, page, key, box."""
    a = on_cells(one.select(*PAGE, F.col("key").alias("a"), "box")).withColumnRenamed("box", "of_a")
    b = on_cells(other.select(*PAGE, F.col("key").alias("b"), "box")).withColumnRenamed("box", "of_b")
    p, q = F.col("of_a"), F.col("of_b")
    meets = (p["x0"] < q["x1"]) & (p["x1"] > q["x0"]) & (p["y0"] < q["y1"]) & (p["y1"] > q["y0"])
    first = (F.col("cx") == _cell(F.greatest(p["x0"], q["x0"]))) & (F.col("cy") == _cell(F.greatest(p["y0"], q["y0"])))
    return a.join(b, [*PAGE, "cx", "cy"]).where(meets & first).select(*PAGE, "a", "b")


def claim_regions(claims: DataFrame, regions: DataFrame) -> DataFrame:
    """(paper, slug, page, key, box): regions (paper, id, region) on the pages that their claims name."""
    places = claims.select("paper", "id", F.col("source_slug").alias("slug"), F.col("source_page").alias("page"))
    return regions.join(places, ["paper", "id"]).select(*PAGE, F.col("id").alias("key"), F.col("region").alias("box"))


def shared_regions(claims: DataFrame, regions: DataFrame) -> DataFrame:
    """(paper, slug, page, a, b): pairs of claims whose regions overlap, the smaller id first."""
    boxes = claim_regions(claims, regions)
    return overlaps(boxes, boxes).where("a < b")


def foreign_hits(claims: DataFrame, regions: DataFrame, hits: DataFrame) -> DataFrame:
    """(paper, slug, page, id, phrase, pos, other): hits of a claim inside the region of another; hits: as of ``evidence.phrase_hits``."""
    places = claims.select("paper", "id", F.col("source_slug").alias("slug"), F.col("source_page").alias("page"))
    boxes = hits.join(places, ["paper", "id"]).select(*PAGE, F.struct("id", "phrase", "pos").alias("key"), F.col("hit").alias("box"))
    rows = overlaps(boxes, claim_regions(claims, regions)).where("a.id <> b")
    return rows.select(*PAGE, "a.*", F.col("b").alias("other"))
