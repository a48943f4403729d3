"""What is said of papers whose text is not at hand, and of those whose text has no label."""

import os

import pyarrow.parquet as pq
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from marginalia import catalog
from marginalia.operators import coverage as V
from marginalia.operators import report as P

LABELS = {1: ["1", "2"], 2: [], 3: None}  # of 3 the text is null, of 4 there is none
SAID = {1: "1/2 labels covered — unaddressed: [2]", 2: "no numbered citation markers found; coverage not audited", 3: None, 4: None}


@pytest.fixture(scope="module")
def parts(spark):
    claim = "paper long, id int, claim string, location string, refs array<string>, verdict string, note string, source_slug string, source_page int, source_block string, evidence_image string"
    claims = spark.createDataFrame([(p, 1, "rose", "§1", ["1"], "supported", "", "", None, "", "") for p in SAID], claim)
    refs = spark.createDataFrame([(p, 1, "1", "Roe", "retrieved", None, None) for p in SAID], "paper long, ord int, num string, raw string, status string, resolver string, reason string")
    return claims, refs, spark.createDataFrame(list(LABELS.items()), "paper long, labels_in_text array<string>")


def both(claims, labels):
    """Coverage as labels alone, and parted."""
    whole = labels.join(V.covered_labels(claims), "paper", "left")
    return labels, whole.withColumns(V.parted(F.col("labels_in_text"), F.col("cited"))).drop("cited")


def test_reports_say_that_papers_without_text_are_not_audited(parts):
    claims, refs, labels = parts
    for coverage in both(claims, labels):
        rows = {r.paper: r.report for r in P.report(claims, refs, coverage).collect()}
        said = {p: next(line for line in t.splitlines() if line.startswith("Citation coverage: ")) for p, t in rows.items()}
        assert said == {p: f"Citation coverage: {t or 'not audited'}" for p, t in SAID.items()}


@pytest.fixture(scope="module")
def untold(spark, small, tmp_path_factory):
    """The small tables, with texts of the first 50 papers only."""
    root = tmp_path_factory.mktemp("untold")
    for name in os.listdir(small):
        os.symlink(f"{small}/{name}", root / name)
    os.unlink(root / "documents.parquet")
    pq.write_table(spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 50").toArrow(), root / "documents.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["K4_report_files", "K8_console"])
def test_queries_on_papers_without_text(spark, untold, name):
    assert spark_rows(catalog.queries()[name](spark, untold)) == duck_rows(catalog.oracle_sql()[name], untold)


def test_the_console_leaves_out_the_coverage_of_papers_without_text(parts):
    claims, refs, labels = parts
    for coverage in both(claims, labels):
        rows = {r.paper: [line for line in r.summary.splitlines() if line.startswith("coverage: ")] for r in P.console(claims, refs, coverage).collect()}
        assert rows == {p: [f"coverage: {t}"] if t else [] for p, t in SAID.items()}
