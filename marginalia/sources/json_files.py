"""The audit's JSON files, read with fixed schemas and defaults, and written.

One file holds one document; the paper's key is the folder it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import geometry as G
from ..functions import judgement as J
from ..functions import text as T
from ..operators import coverage as V
from ..operators import report as P

CONVERTER, CHECKER = "pymupdf", "Claude"  # fixed values: what files of older runs mean where they say nothing


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("paper", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def source_maps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents (paper, doc, pages, converter) and blocks."""
    return source_maps_of(_read(spark, path, S.SOURCE_MAP))


def source_maps_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``source_maps`` of parsed files: paper, and the fields of SOURCE_MAP."""
    docs = rows.select("paper", "doc", "pages", F.coalesce("converter", F.lit(CONVERTER)).alias("converter"))
    return docs, source_map_rows_of(rows).drop("converter")


def source_map_rows_of(rows: DataFrame) -> DataFrame:
    """Blocks with their document's ``converter``, which come from one reading."""
    blocks = rows.select("paper", F.coalesce("converter", F.lit(CONVERTER)).alias("converter"), F.posexplode("blocks").alias("seq", "b"))
    box = G.box(*(F.get("b.bbox", F.lit(k)) for k in range(4)))
    none = F.array().cast("array<string>")
    return blocks.select("paper", "converter", "seq", "b.id", "b.type", "b.page", box.alias("bbox"), F.coalesce("b.heading_path", none).alias("heading_path"), F.coalesce("b.text", F.lit("")).alias("text"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """References with their manuscript's name."""
    return manifests_of(_read(spark, path, S.MANIFEST))


def manifests_of(rows: DataFrame) -> DataFrame:
    """``manifests`` of parsed files: paper, and the fields of MANIFEST."""
    rows = rows.select("paper", "manuscript", F.posexplode("entries").alias("ord", "e"))
    return rows.select("paper", "manuscript", "ord", "e.*").withColumns({"status": F.coalesce("status", F.lit("error")), "reason": F.coalesce("reason", F.lit(""))})


def results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, claims and uncited assertions; what an older file lacks is empty."""
    return results_of(_read(spark, path, S.RESULTS))


def results_of(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``results`` of parsed files: paper, and the fields of RESULTS."""
    none = F.array().cast("array<string>")
    runs = rows.select("paper", "manuscript", F.coalesce("checker", F.lit(CHECKER)).alias("checker"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("refs.total", F.lit(0)).alias("refs_total"), F.coalesce("refs.available", F.lit(0)).alias("refs_available"), F.coalesce("converter", F.lit(CONVERTER)).alias("converter"), *(F.coalesce(f"coverage.{k}", none).alias(k) for k in ("labels_in_text", "covered", "missing")))
    claims = rows.select("paper", F.explode("claims").alias("c")).select("paper", "c.*")
    claims = claims.withColumns({"refs": F.coalesce("refs", none), "anchor_phrases": F.coalesce("anchor_phrases", none), "verdict": F.coalesce("verdict", F.lit("not_retrieved")), "note": F.coalesce("note", F.lit(""))})
    uncited = rows.select("paper", F.explode("uncited").alias("u")).select("paper", "u.id", "u.claim", F.coalesce("u.location", F.lit("")).alias("location"))
    return runs, claims, uncited


def scouts(spark: SparkSession, path: str) -> DataFrame:
    """What was found around each paper; what an older file lacks is empty."""
    rows = spark.read.schema(S.SCOUT).option("multiLine", True).json(path).withColumnRenamed("paper", "of")
    return scouts_of(rows.withColumn("paper", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)))


def scouts_of(rows: DataFrame) -> DataFrame:
    """``scouts`` of parsed files: paper, and the fields of SCOUT, its ``paper`` as ``of``."""
    none = F.array().cast(S.HIT)
    known = [F.coalesce(f"of.{k}", F.lit("")).alias(f"paper_{k}") for k in ("title", "doi")]
    return rows.select("paper", *known, F.col("of.year").alias("paper_year"), F.coalesce("of.resolved_via", F.lit("")).alias("resolved_via"), F.coalesce("query", F.lit("")).alias("query"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("newer", none).alias("newer"), F.coalesce("overlooked", none).alias("overlooked"), F.coalesce("error", F.lit("")).alias("error"))


# -- writing ------------------------------------------------------------------
def source_map_json(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper, json): a source map with a preview of each block."""
    bbox = F.array(*(F.col(f"bbox.{k}") for k in ("x0", "y0", "x1", "y1")))
    one = F.struct("seq", F.struct("id", "type", "page", bbox.alias("bbox"), "heading_path", "text", T.preview(F.col("text")).alias("text_preview")).alias("b"))
    lists = blocks.groupBy("paper").agg(F.array_sort(F.collect_list(one)).alias("r")).select("paper", F.col("r.b").alias("blocks"))
    return docs.join(lists, "paper", "left").select("paper", F.to_json(F.struct("doc", "pages", "converter", F.coalesce("blocks", F.array()).alias("blocks")), {"ignoreNullFields": "false"}).alias("json"))


def manifest_json(refs: DataFrame) -> DataFrame:
    """(paper, json): a manifest with its summary; refs carry ``manuscript``."""
    fields = ["num", "raw", "doi", "title", "year", "status", "reason", "resolver", "pdf_path", "slug"]
    rows = refs.groupBy("paper", "manuscript").agg(
        F.count("*").alias("total"), F.count_if(J.is_available(F.col("status"))).alias("available"), *J.counts(F.col("status"), J.STATUSES), F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("e")))).alias("r")
    )
    summary = F.struct("total", "available", F.struct(*J.STATUSES).alias("by_status"))
    return rows.select("paper", F.to_json(F.struct("manuscript", summary.alias("summary"), F.col("r.e").alias("entries")), {"ignoreNullFields": "false"}).alias("json"))


def results_json(runs: DataFrame, claims: DataFrame, uncited: DataFrame | Column) -> DataFrame:
    """(paper, json): the results of a run, with its counts.

    uncited: the assertions without a reference, or which of the claims they
    are; runs that know the labels of their texts alone are covered by what the
    claims cite.
    """
    fields = ["id", "claim", "location", "refs", "verdict", "note", "source_slug", "source_page", "source_block", "anchor_phrases", "evidence_image"]
    assertion = ("id", "claim", "location")
    lists = [F.array_sort(F.collect_list(F.struct(*fields))).alias("claims"), V.cited().alias("cited"), *J.counts(F.col("verdict"), J.VERDICTS)]
    if isinstance(uncited, Column):
        lists.append(P.in_order(uncited, *assertion).alias("uncited"))
    rows = runs.join(claims.groupBy("paper").agg(*lists), "paper", "left")
    if not isinstance(uncited, Column):
        rows = rows.join(uncited.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct(*assertion))).alias("uncited")), "paper", "left")
    if "missing" not in runs.columns:
        rows = rows.withColumns({k: F.when(F.col("labels_in_text").isNotNull(), c) for k, c in V.parted(F.col("labels_in_text"), F.col("cited")).items()})
    counts = F.struct(*(F.coalesce(v, F.lit(0)).alias(v) for v in J.VERDICTS))
    whole = F.struct("manuscript", "checker", "date", F.struct(F.col("refs_total").alias("total"), F.col("refs_available").alias("available")).alias("refs"), "converter", counts.alias("counts"), F.coalesce("claims", F.array()).alias("claims"), F.coalesce("uncited", F.array()).alias("uncited"), F.struct("labels_in_text", "covered", "missing").alias("coverage"))
    return rows.select("paper", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def scout_json(scouted: DataFrame, newer: DataFrame, overlooked: DataFrame) -> DataFrame:
    """(paper, json): what was found around each paper; hits carry ``rank``, scouted is as of ``report.scout_section`` with a date."""
    hit = F.struct("title", "year", "doi", "via", "journal", "authors")
    rows = scouted
    for name, hits in (("newer", newer), ("overlooked", overlooked)):
        rows = rows.join(hits.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("rank", hit.alias("h")))).alias("r")).select("paper", F.col("r.h").alias(name)), "paper", "left")
    of = F.struct(F.col("paper_title").alias("title"), F.col("paper_doi").alias("doi"), F.col("paper_year").alias("year"), "resolved_via")
    whole = F.struct(of.alias("paper"), "query", "date", F.coalesce("newer", F.array()).alias("newer"), F.coalesce("overlooked", F.array()).alias("overlooked"), F.coalesce("error", F.lit("")).alias("error"))
    return rows.select("paper", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def write_texts(rows: DataFrame, path: str, text_col: str) -> None:
    """A folder for each paper with its text, one row a file's content.

    For the papers of one user; many papers' texts are better kept as one table
    (paper, text), as every paper is a folder and a file here.
    """
    rows.select("paper", F.col(text_col).alias("value")).write.partitionBy("paper").text(path, lineSep="")
