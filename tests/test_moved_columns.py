"""What the derived tables and the evidence move: narrow columns, and no rows that nothing depends on."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from marginalia.plans import catalog_tables as T
from marginalia.plans import derived as D
from marginalia.sources import page_index


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def line_of(plan, word):
    return next(k for k, line in enumerate(plan) if word in line)


@pytest.mark.parametrize(("name", "made"), [("claim_rows", "claim on part"), ("raw_blocks", "repeat("), ("ref_lines", "imaging of lancet"), ("found", "number ")])
def test_texts_are_made_above_the_numbering(spark, small, name, made):
    plan = plan_of(D.table(spark, small, name))
    assert line_of(plan, made) < line_of(plan, "Window")


def test_only_the_claims_pages_are_indexed(spark, small, monkeypatch):
    got = []
    monkeypatch.setattr(page_index.PageIndex, "append", lambda self, words: got.append(words.select("paper", "slug", "page").distinct().collect()) or self.table())
    claims, blocks = T._placed(spark, small, "text")
    T._hits(spark, claims, blocks)
    named = {(r.paper, r.source_slug, r.source_page) for r in D.claims(spark, small).collect()}
    there = {(r.paper, r.slug, r.page) for r in blocks.collect()}
    assert {tuple(r) for r in got[0]} == named & there
    assert {(r.paper, r.source_slug, r.source_page) for r in claims.collect()} == named & there


def test_a_first_append_joins_nothing(spark, tmp_path, monkeypatch):
    index = page_index.PageIndex(spark, str(tmp_path / "i"), buckets=4)
    words = spark.createDataFrame([("p", "s", 1, k, w, 0.0, 0.0, 1.0, 1.0) for k, w in enumerate(["A", "a", None, "b"])], "paper string, slug string, page int, pos int, word string, x0 double, y0 double, x1 double, y1 double")
    joins, own = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, *a, **k: joins.append(1) or own(self, *a, **k))
    index.append(words)
    assert joins == []
    index.append(words)  # the page is there: left out
    assert joins == [1]
    assert sorted((r.word, [h.pos for h in r.hits]) for r in index.table().collect()) == [("a", [0, 1]), ("b", [3])]
    index.drop()


def test_references_and_files_are_not_broadcast(spark, small):
    from marginalia.operators import retrieval as W

    refs, files = D.refs(spark, small), D.table(spark, small, "files")
    for rows in (W.match_provided(refs, files), W.accepted(D.table(spark, small, "downloads"), refs)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert any("SortMergeJoin" in line for line in joins)
        assert not any("BroadcastHashJoin" in line and ("piece" in line or "ord#" in line) for line in joins)
