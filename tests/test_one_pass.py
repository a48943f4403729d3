"""Pages, reports and result files gather a paper's claims once, whatever is told of them."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia import catalog
from marginalia.operators import claims as C
from marginalia.operators import html as H
from marginalia.operators import report as P
from marginalia.operators import scout
from marginalia.plans import catalog_tables as T


def scans(df, word):
    return sum("Relation" in line and word in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.mark.parametrize("name", ["K4b_html", "K4b_terminal", "K4b_page_rows", "K4_report", "K8_console", "S4_results_claims", "S4_results_runs", "S4_results_uncited"])
def test_papers_read_the_claims_once(spark, small, name):
    assert scans(catalog.queries()[name](spark, small), "l_partkey") == 1


def test_pages_are_those_of_separate_tables(spark, small):
    claims, _, _, *registers = T._page_parts(spark, small)
    apart = H.all_pages(claims, T._uncited(spark, small), T._covered(spark, small), *registers, **T._page_heads(spark, small))
    for look in H.LOOKS:
        rows = {r.paper: r.html for r in apart.where(F.col("look") == look).collect()}
        assert rows == {r.paper: r.html for r in T._pages(look)(spark, small).collect()} and rows


def test_reports_are_those_of_separate_tables(spark, small):
    claims, refs = T.D.claims(spark, small), T.D.refs(spark, small)
    scouted = P.scout_section(*T._registers(spark, small), T._scouted(spark, small))
    apart = P.report(claims, refs, T._covered(spark, small), T._runs(spark, small), T._uncited(spark, small), scouted)
    rows = {r.paper: r.report for r in apart.collect()}
    assert rows == {r.paper: r.report for r in T._report(spark, small).collect()} and rows


def test_the_fold_gets_each_set_of_keys_once(spark):
    pick = random.Random(5)
    rows = [(1, k, pick.choice(["citing", "search"]), pick.choice(["", "one", "two", "three", "four"]), 2000, pick.choice(["", "10.1/a", "10.1/b", "10.1/c"]), "j", "a") for k in range(400)]
    hits = spark.createDataFrame(rows, "paper long, ord int, via string, title string, year int, doi string, journal string, authors string")
    assert scout.first_of_keys(hits).count() == 5 * 4 - 1
    seen, wanted = {"10.1/b"}, []
    for r in sorted(rows, key=lambda r: (r[2] != "citing", r[1])):
        keys = {r[3], r[5]} - {""}
        if keys and not keys & seen:
            seen |= keys
            wanted.append(r[1])
    own = spark.createDataFrame([(1, "", "10.1/B", 2001)], "paper long, paper_title string, paper_doi string, paper_year int")
    assert sorted(r.ord for r in scout.ordered_dedup(hits, own).collect()) == sorted(wanted)


@pytest.mark.parametrize("name", ["J4_merge_verdicts", "F26_prompt"])
def test_claims_meet_references_by_paper(spark, small, name):
    plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    keys = [line.split("hashpartitioning(")[1] for line in moved]
    assert moved and not any("num#" in k for k in keys)


def test_the_first_entry_of_a_number_counts(spark):
    claims = spark.createDataFrame([("p", 1, ["7", None, "8"]), ("p", 2, []), ("q", 1, ["7"])], "paper string, id int, refs array<string>")
    refs = spark.createDataFrame([("p", 3, "7", "error", "late"), ("p", 1, "7", "retrieved", "early"), ("p", 2, None, "retrieved", "none")], "paper string, ord int, num string, status string, slug string")
    rows = {(r.paper, r.id, r.pos): (r.num, r.status, r.slug) for r in C.cited_entries(claims, refs).collect()}
    assert rows == {("p", 1, 0): ("7", "retrieved", "early"), ("p", 1, 1): (None, None, None), ("p", 1, 2): ("8", None, None), ("p", 2, None): (None, None, None), ("q", 1, 0): ("7", None, None)}


def test_source_maps_are_parsed_once(spark, small):
    assert scans(catalog.queries()["S4_source_maps"](spark, small), "l_partkey") == 2  # the documents, and their blocks
