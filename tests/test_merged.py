"""Merged summaries against those of all rows."""

import random

from pyspark.sql import functions as F

from marginalia.operators import coverage as V
from marginalia.operators import ingest as I
from marginalia.operators import merged as M
from marginalia.plans import derived as D


def rows(df):
    return sorted(map(str, df.collect()))


def test_every_label_has_its_bit(spark):
    labels = [f"{k:0{n}d}" for n in (1, 2, 3) for k in range(10**n)]
    data = spark.createDataFrame([(x,) for x in labels], "label string")
    found = data.select("label", M.bit_of(F.col("label")).alias("bit")).withColumn("back", M.label_of(F.col("bit"))).collect()
    assert [r.bit for r in found] == list(range(M.BITS)) and all(r.label == r.back for r in found)
    odd = spark.createDataFrame([("1000",), ("x",), ("",), (None,), ("٣",), ("-1",)], "label string")
    assert all(r[0] is None for r in odd.select(M.bit_of(F.col("label"))).collect())


def test_coverage_as_before(spark, small):
    texts, claims = D.table(spark, small, "papers"), D.claims(spark, small)
    wanted = rows(V.coverage_audit(texts, claims).select("paper", "labels_in_text", "covered", "missing", "status"))
    assert rows(M.coverage_by_bits(texts, M.cited_bits(claims))) == wanted
    halves = [M.cited_bits(claims.where(F.col("id") % 2 == k)) for k in (0, 1)]
    assert rows(M.coverage_by_bits(texts, M.merge_bits(halves[0].unionByName(halves[1])))) == wanted


def test_odd_labels(spark):
    texts = spark.createDataFrame([("a", "[7] [07] [007] [1-3] [999]"), ("b", "none"), ("c", None)], "paper string, clean_md string")
    claims = spark.createDataFrame([("a", ["07", "2", "1000", "x", None]), ("a", None), ("a", []), ("z", ["1"])], "paper string, refs array<string>")
    assert rows(M.coverage_by_bits(texts, M.cited_bits(claims))) == rows(V.coverage_audit(texts, claims))
    assert M.coverage_by_bits(texts.limit(0), M.cited_bits(claims.limit(0))).count() == 0


def test_sizes_merge(spark, small):
    raw = I.text_blocks(D.raw_blocks(spark, small))
    halves = [raw.where(F.col("seq") % 2 == k) for k in (0, 1)]
    counts = M.merge_counts(M.size_counts(halves[0]), M.size_counts(halves[1]))
    assert rows(M.body_size(counts)) == rows(I.body_size(raw)) == rows(M.body_size(M.size_counts(raw)))
    known = M.heading_candidates(halves[0]).unionByName(M.heading_candidates(halves[1]))
    assert rows(M.headings(known, counts)) == rows(I.flat_blocks(D.raw_blocks(spark, small)).where("type = 'sectionheader'").select("paper", "seq"))


def test_medians(spark):
    rng = random.Random(2)
    data = [(p, k, "x" * rng.choice([10, 81, 200]), float(rng.choice([8, 9, 9.5, 12]))) for p in range(30) for k in range(rng.choice([1, 2, 5, 8]))]
    raw = spark.createDataFrame(data, "paper int, seq int, text string, size double")
    assert rows(M.body_size(M.size_counts(raw))) == rows(I.body_size(raw))
