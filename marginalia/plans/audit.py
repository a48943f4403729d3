"""A whole audit, and the checks around it."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import coverage, evidence, ingest, references, report
from ..sources import seams
from . import retrieve


def contact(given: str | None, names: tuple[str, ...] = ("AUDIT_EMAIL",)) -> str:
    """The address that web services ask for; an error where none is set."""
    found = given or next((v for n in names if (v := os.environ.get(n))), "")
    if not found:
        raise ValueError("no contact address is set")
    return found


def conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(paper, previous, manuscript) of papers whose folder holds another manuscript; both: paper, manuscript."""
    rows = incoming.join(existing.select("paper", F.col("manuscript").alias("previous")), "paper")
    return rows.where("previous <> manuscript").select("paper", "previous", "manuscript").distinct()


def guard(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows; an error where a folder belongs to another manuscript."""
    for row in conflicts(existing, incoming).limit(1).collect():
        raise ValueError(f"{row['paper']} already holds an audit of {row['previous']}")
    return incoming


@dataclass
class Admitted:
    """Papers that an audit goes on with, and a row (paper, exit, reason) for each that it doesn't."""

    papers: DataFrame
    refused: DataFrame


# Exits of a run.
EXIT_CONFLICT, EXIT_NO_REFERENCES = 2, 1


def admit(existing: DataFrame, incoming: DataFrame, parsed: DataFrame) -> Admitted:
    """What ``guard`` and ``require_references`` end a run for, by paper: one that can't be audited doesn't stop the others.

    A paper with both faults has the exit of the conflict, which comes first.
    """
    taken = conflicts(existing, incoming).groupBy("paper").agg(F.min("previous").alias("previous"))
    clash = taken.select("paper", F.lit(EXIT_CONFLICT).alias("exit"), F.concat(F.lit("the folder already holds an audit of "), "previous").alias("reason"))
    bare = unreferenced(incoming, parsed).join(taken, "paper", "left_anti").select("paper", F.lit(EXIT_NO_REFERENCES).alias("exit"), F.lit("no references found").alias("reason"))
    refused = clash.unionByName(bare)
    return Admitted(incoming.join(refused, "paper", "left_anti"), refused)


def reuse(done: DataFrame, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results that are there already, and those that ``make`` gives for the papers without one."""
    return done.unionByName(make(seams.only_new(rows, done)))


def unreferenced(papers: DataFrame, parsed: DataFrame) -> DataFrame:
    """(paper) of the papers in which no reference was found."""
    return papers.select("paper").distinct().join(parsed, "paper", "left_anti")


def quiet(spark: SparkSession) -> None:
    """Only errors on the console."""
    spark.sparkContext.setLogLevel("ERROR")
    logging.getLogger("py4j").setLevel(logging.ERROR)


@dataclass
class Audit:
    blocks: DataFrame
    refs: DataFrame
    claims: DataFrame
    coverage: DataFrame
    report: DataFrame


def run(raw_blocks: DataFrame, refs: DataFrame, claims: DataFrame, sources: DataFrame, template: str, judge: seams.Judge) -> Audit:
    """Blocks, verdicts, coverage and reports of many papers.

    refs are resolved references (``operators.retrieval``), claims extracted
    ones, sources (paper, slug, annotated_md) the texts that were read.
    """
    blocks = ingest.flat_blocks(raw_blocks)
    texts = ingest.markdown(blocks)
    whole = judged(claims, refs, sources, template, judge).withColumn("evidence_image", F.lit(None).cast("string"))
    covered = coverage.coverage_audit(texts, claims)
    return Audit(blocks, refs, whole, covered, report.report(whole, refs, covered))


def judged(claims: DataFrame, refs: DataFrame, sources: DataFrame, template: str, judge: seams.Judge, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, _: rows) -> DataFrame:
    """The claims with their verdicts: routed to a source that was read, asked one source at a time, merged.

    Both the routes and the answers are used twice; unless they are kept, so is the judge.
    """
    routed = keep(C.route(claims, refs), "routed")
    answers = keep(seams.ask(C.prompts(claims, routed, sources, template), judge), "answers")
    return claims.select("paper", "id", "claim", "location", "refs").join(C.merge_verdicts(routed, answers), ["paper", "id"])


@dataclass
class Outside:
    """What an audit needs from beyond the tables.

    get: address to (status, body); judge: prompt to answer; first_page: body to
    the text of its first page, as columns; read: resolved references to
    ``Sources``; keep: writes a stage's rows and reads them back.
    """

    get: Callable[[str], tuple[int, bytes]]
    judge: seams.Judge
    first_page: Callable[[Column], Column]
    read: Callable[[DataFrame], Sources]
    keep: Callable[[DataFrame, str], DataFrame]


@dataclass
class Sources:
    """Sources that were read: texts (paper, slug, annotated_md), and where crops are wanted their blocks, words and pages as of ``operators.evidence``."""

    texts: DataFrame
    blocks: DataFrame | None = None
    words: DataFrame | None = None
    pages: DataFrame | None = None


@dataclass
class Whole:
    blocks: DataFrame
    refs: DataFrame
    newer: DataFrame
    overlooked: DataFrame
    scout_errors: DataFrame
    claims: DataFrame
    uncited: DataFrame
    crops: DataFrame | None
    coverage: DataFrame
    report: DataFrame


def audit(raw_blocks: DataFrame, manuscripts: DataFrame, existing: DataFrame, files: DataFrame, outside: Outside, extraction: str, checking: str, email: str | None = None, runs: DataFrame | None = None) -> Whole:
    """Whole audits of many papers, from decoded blocks to reports.

    manuscripts: (paper, manuscript); existing: those that the papers' folders
    hold already; files: the user's sources (paper, name); extraction and
    checking: the judge's templates.  The contact address and the folders are
    checked before anything is fetched.  A search around a paper that fails
    leaves the rest of its audit as it is.
    """
    address = contact(email)
    guard(existing, manuscripts)
    keep = outside.keep
    # the texts, the lists and the titles are all made from the blocks, and a list is looked at more than once
    blocks = keep(ingest.flat_blocks(raw_blocks), "blocks")
    texts = keep(ingest.markdown(blocks), "texts")
    parsed = keep(references.parse_references(keep(references.references_section(blocks), "sections")), "parsed")
    if parsed.isEmpty():
        raise ValueError("no paper has a reference")
    found = retrieve.retrieve(parsed, files, outside.get, outside.first_page, address, keep)
    refs = keep(parsed.drop("doi").join(found, ["paper", "ord"]), "refs")

    papers = keep(ingest.paper_title(blocks), "titles").withColumn("doi", F.lit(None).cast("string"))
    newer, overlooked, errors = retrieve.scout_papers(papers, refs, outside.get, keep)

    asked = keep(seams.ask(C.extraction_prompts(texts, extraction), outside.judge), "extraction")
    claims, uncited = C.extracted(asked)
    sources = outside.read(refs)
    whole = keep(judged(claims, refs, sources.texts, checking, outside.judge, keep), "judged")
    crops, image = None, F.lit(None).cast("string")
    if sources.blocks is not None:
        crops = keep(evidence.crops(whole, sources.blocks, sources.words, sources.pages), "crops")
        whole = whole.join(crops.select("paper", "id", "file"), ["paper", "id"], "left")
        image = F.concat(F.lit("evidence/"), F.col("file"))
    whole = whole.withColumn("evidence_image", image).drop("file")
    covered = coverage.coverage_audit(texts, claims)
    known = [F.lit(None).cast(kind).alias(name) for name, kind in (("paper_title", "string"), ("paper_year", "int"), ("paper_doi", "string"), ("resolved_via", "string"), ("query", "string"))]
    scout = report.scout_section(newer, overlooked, errors.select("paper", *known, "error"))
    return Whole(blocks, refs, newer, overlooked, errors, whole, uncited, crops, covered, report.report(whole, refs, covered, runs, uncited, scout))


def parse_only(raw_blocks: DataFrame) -> DataFrame:
    """References of each paper, nothing fetched."""
    return references.parse_references(references.references_section(ingest.flat_blocks(raw_blocks)))
