"""Queries over whole tables leave no paper out."""

from marginalia import catalog
from marginalia.operators import claims as C
from marginalia.operators import coverage as V
from marginalia.operators import ingest as I
from marginalia.operators import references as R
from marginalia.plans import derived as D


def keys(rows, *names):
    return sorted(map(tuple, rows.select(*names).collect()))


def test_every_claim_is_merged(spark, small):
    claims = D.claims(spark, small)
    assert claims.where("paper > 100").count() > 0
    assert keys(catalog.queries()["J4_merge_verdicts"](spark, small), "paper", "id") == keys(C.route(claims, D.refs(spark, small)), "paper", "id")


def test_every_paper_has_a_source_map(spark, small):
    blocks = I.flat_blocks(D.raw_blocks(spark, small))
    assert keys(catalog.queries()["K1_source_map_json"](spark, small), "paper", "id") == keys(blocks, "paper", "id")


def test_every_reference_is_asked(spark, small):
    assert keys(catalog.queries()["S9_ask"](spark, small), "paper", "slug") == keys(D.refs(spark, small), "paper", "slug")


def test_claims_of_every_paper_cover(spark, small):
    found = catalog.queries()["coverage_audit"](spark, small)
    assert found.where("paper % 3 = 0 and size(covered) > 0").count() > 0
    whole = V.coverage_audit(D.table(spark, small, "papers"), D.claims(spark, small))
    assert keys(found, "paper", "covered", "missing") == keys(whole, "paper", "covered", "missing")


def test_bullets_of_any_paper_are_read(spark):
    rows = spark.createDataFrame([(1, "- one\n- two"), (7, "- three")], "paper long, section string")
    assert keys(R.bulleted_rows(rows), "paper", "raw") == [(1, "one"), (1, "two"), (7, "three")]
