"""Where on a source's page the evidence for a claim is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

KEY = ["paper", "id"]


def anchored(claims: DataFrame, files: DataFrame, only: int | None = None) -> DataFrame:
    """Claims with a source, a page (not 0) and a resolved file (paper, slug); ``only`` picks one id."""
    rows = claims.where("source_slug <> '' and source_page <> 0")
    rows = rows if only is None else rows.where(F.col("id") == only)
    return rows.join(files.select("paper", F.col("slug").alias("source_slug")), ["paper", "source_slug"], "left_semi")


def source_file(claims: DataFrame, resolved: DataFrame, refs: DataFrame) -> DataFrame:
    """(paper, id, file): a claim's resolved file, else the path in its reference (the first of its slug)."""
    paths = refs.where("slug <> ''").groupBy("paper", F.col("slug").alias("source_slug")).agg(F.min_by("pdf_path", "ord").alias("pdf_path"))
    files = resolved.select("paper", F.col("slug").alias("source_slug"), "path")
    rows = claims.where("source_slug <> ''").join(files, ["paper", "source_slug"], "left").join(paths, ["paper", "source_slug"], "left")
    return rows.select("paper", "id", F.coalesce("path", "pdf_path").alias("file"))


def block_regions(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper, id, region): the box of a claim's block, if it is on the claim's page; blocks: paper, slug, seq, id, page, bbox."""
    first = blocks.groupBy("paper", F.col("slug").alias("source_slug"), F.col("id").alias("source_block")).agg(F.min_by(F.struct("page", "bbox"), "seq").alias("b"))
    rows = claims.join(first, ["paper", "source_slug", "source_block"])
    return rows.where(F.col("b.page") == F.col("source_page")).select("paper", "id", F.col("b.bbox").alias("region"))


def phrase_hits(claims: DataFrame, words: DataFrame) -> DataFrame:
    """(paper, id, phrase, pos, hit): each place of a claim's phrases on its page.

    words: paper, slug, page, pos, word, x0, y0, x1, y1.  A phrase is where its
    words follow one another: an equi-join of words, counted by where the
    phrase would begin.
    """
    phrases = claims.select(*KEY, F.col("source_slug").alias("slug"), F.col("source_page").alias("page"), F.posexplode("anchor_phrases").alias("phrase", "text"))
    cut = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    parts = phrases.withColumn("cut", cut).select(*KEY, "slug", "page", "phrase", F.size("cut").alias("n"), F.posexplode("cut").alias("k", "word"))
    page = words.select("paper", "slug", "page", "pos", F.lower("word").alias("word"), "x0", "y0", "x1", "y1")
    rows = parts.join(page, ["paper", "slug", "page", "word"]).withColumn("begin", F.col("pos") - F.col("k"))
    whole = rows.groupBy(*KEY, "phrase", "n", F.col("begin").alias("pos")).agg(F.count("*").alias("found"), *_union())
    return whole.where("found = n").select(*KEY, "phrase", "pos", G.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("hit"))


def indexed_hits(claims: DataFrame, index: DataFrame) -> DataFrame:
    """``phrase_hits`` from stored postings (paper, slug, page, word, hits), as of ``sources.page_index``.

    A phrase meets the postings of its own words only; where it begins is what
    their places, each less its word's number, have in common.
    """
    phrases = claims.select(*KEY, F.col("source_slug").alias("slug"), F.col("source_page").alias("page"), F.posexplode("anchor_phrases").alias("phrase", "text"))
    cut = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    parts = phrases.withColumn("cut", cut).select(*KEY, "slug", "page", "phrase", F.size("cut").alias("n"), F.posexplode("cut").alias("k", "word"))
    met = parts.join(index, ["paper", "slug", "page", "word"]).groupBy(*KEY, "phrase", "n").agg(F.array_sort(F.collect_list(F.struct("k", "hits"))).alias("words")).where("size(words) = n")
    begins = lambda p: F.transform(p["hits"], lambda h: h["pos"] - p["k"])
    common = F.aggregate(F.slice("words", F.lit(2), F.size("words")), begins(F.get("words", F.lit(0))), lambda acc, p: F.array_intersect(acc, begins(p)))
    # the places of each word of the phrase at those beginnings
    places = F.flatten(F.transform("words", lambda p: F.transform(F.filter(p["hits"], lambda h: F.array_contains(F.col("common"), h["pos"] - p["k"])), lambda h: F.struct((h["pos"] - p["k"]).alias("pos"), h["x0"].alias("x0"), h["y0"].alias("y0"), h["x1"].alias("x1"), h["y1"].alias("y1")))))
    each = met.withColumn("common", common).where("size(common) > 0").select(*KEY, "phrase", F.explode(places).alias("h"))
    whole = each.select(*KEY, "phrase", "h.*").groupBy(*KEY, "phrase", "pos").agg(*_union())
    return whole.select(*KEY, "phrase", "pos", G.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("hit"))


def _union() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def _around() -> Column:
    """The union of a claim's hits, padded."""
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    return G.box(x0 - G.UNION_PAD_X, y0 - G.UNION_PAD_Y, x1 + G.UNION_PAD_X, y1 + G.UNION_PAD_Y)


def hit_regions(hits: DataFrame) -> DataFrame:
    """(paper, id, region): the union of a claim's hits, padded, for claims without a block."""
    rows = hits.select(*KEY, "hit.*").groupBy(*KEY).agg(*_union())
    return rows.select(*KEY, _around().alias("region"))


def crops(claims: DataFrame, blocks: DataFrame, words: DataFrame | None, pages: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(paper, id, file, region, zoom, boxes): what to draw for each claim; pages: paper, slug, page, width, height.

    hits: those of ``indexed_hits``, where the pages' words are indexed.

    A claim's hits are found once and stay with it as an array, from which the
    region and the boxes inside it are read.
    """
    each = (phrase_hits(claims, words) if hits is None else hits).select(*KEY, "phrase", "pos", "hit", "hit.*")
    per = each.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("phrase", "pos", "hit"))).alias("hits"), *_union())
    per = per.select(*KEY, "hits", _around().alias("around"))
    own = block_regions(claims, blocks).withColumnRenamed("region", "own")
    sizes = pages.select("paper", F.col("slug").alias("source_slug"), F.col("page").alias("source_page"), "width", "height")
    rows = claims.select(*KEY, "source_slug", "source_page").join(own, KEY, "left").join(per, KEY, "left").where("own is not null or around is not null")
    rows = rows.join(sizes, ["paper", "source_slug", "source_page"]).withColumn("region", G.padded(F.coalesce("own", "around"), F.col("width"), F.col("height")))
    rows = rows.select(*KEY, G.crop_name(F.col("id"), F.col("source_slug"), F.col("source_page")).alias("file"), "region", G.zoom(F.col("region")).alias("zoom"), "hits")
    region = F.col("region")
    inside = lambda h: (h["hit"]["x0"] < region["x1"]) & (h["hit"]["x1"] > region["x0"]) & (h["hit"]["y0"] < region["y1"]) & (h["hit"]["y1"] > region["y0"])
    boxes = F.transform(F.filter("hits", inside), lambda h: G.pixels(h["hit"], region, F.col("zoom")))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return rows.select(*KEY, "file", "region", "zoom", F.coalesce(boxes, none).alias("boxes"))
