"""Bitmaps are made of a paper's labels, not of each claim's."""

from marginalia.operators import merged as MG


def test_one_bitmap_a_paper(spark):
    rows = [("a", ["1", "07"]), ("a", ["1", None, "x"]), ("a", None), ("b", []), ("c", None)]
    claims = spark.createDataFrame(rows, "paper string, refs array<string>")
    found = MG.cited_bits(claims)
    each = MG.merge_bits(claims.select("paper", MG.bitmap(claims.refs).alias("bits")))
    assert sorted((r.paper, r.bits) for r in found.collect()) == sorted((r.paper, r.bits) for r in each.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" not in plan
