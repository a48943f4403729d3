"""Summaries of papers that merge: label sets as bitmaps, and block sizes as histograms.

Both stand for any number of rows of a paper by a few words, and those of two
halves give those of the whole; so what has been summed up is kept, and new
claims or pages are added without reading the old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import by_number, labels_in_text
from . import coverage, ingest

# -- labels -------------------------------------------------------------------
#: Labels of one, two and three digits, leading zeros told apart: as many bits, in words of 64.
PLACES = (0, 10, 110)
BITS = 1110
WORDS = -(-BITS // 64)


def bit_of(label: Column) -> Column:
    """A label's bit; null for what is no label of three digits at most, which no text holds."""
    start = F.get(F.array(*map(F.lit, PLACES)), F.length(label) - 1)
    return F.when(label.rlike("^[0-9]{1,3}$"), start + label.try_cast("int"))


def label_of(bit: Column) -> Column:
    digits = F.when(bit < PLACES[1], 1).when(bit < PLACES[2], 2).otherwise(3)
    return F.lpad((bit - F.get(F.array(*map(F.lit, PLACES)), digits - 1)).cast("string"), digits, F.lit("0"))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (k % 64).cast("int"))


def bitmap(labels: Column) -> Column:
    """``array<long>`` of WORDS: the set of an array's labels; null is the empty set."""
    bits = F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), bit_of), lambda k: k.isNotNull())
    word = lambda w: F.aggregate(F.filter(bits, lambda k: F.floor(k / 64) == w), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(_bit(k)))
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word)


def labels_of(words: Column) -> Column:
    """The labels of a bitmap, in order."""
    there = lambda k: F.get(words, F.floor(k / 64).cast("int")).bitwiseAND(_bit(k)) != 0
    return by_number(F.transform(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), there), label_of))


def cited_bits(claims: DataFrame) -> DataFrame:
    """(paper, bits) of claims (paper, refs): a paper's distinct labels are made one bitmap, not those of each claim."""
    return claims.groupBy("paper").agg(bitmap(F.array_distinct(F.flatten(F.collect_set("refs")))).alias("bits"))


def merge_bits(parts: DataFrame) -> DataFrame:
    """(paper, bits) of any number of sets a paper."""
    rows = parts.groupBy("paper").agg(*(F.bit_or(F.get("bits", F.lit(k))).alias(f"w{k}") for k in range(WORDS)))
    return rows.select("paper", F.array(*(f"w{k}" for k in range(WORDS))).alias("bits"))


def coverage_by_bits(texts: DataFrame, cited: DataFrame) -> DataFrame:
    """The rows of ``coverage.coverage_audit`` from texts (paper, clean_md) and merged sets (paper, bits)."""
    rows = texts.select("paper", labels_in_text(F.col("clean_md")).alias("labels_in_text"))
    rows = rows.withColumn("text", bitmap(F.col("labels_in_text"))).join(cited, "paper", "left")
    none = F.array_repeat(F.lit(0).cast("long"), WORDS)
    rows = rows.withColumn("bits", F.coalesce("bits", none))
    covered = F.zip_with("text", "bits", lambda t, c: t.bitwiseAND(c))
    missing = F.zip_with("text", "bits", lambda t, c: t.bitwiseAND(F.bitwise_not(c)))
    known = lambda words: F.when(F.col("labels_in_text").isNotNull(), labels_of(words))  # noqa: E731 - a null text has no sets
    rows = rows.select("paper", "labels_in_text", known(covered).alias("covered"), known(missing).alias("missing"))
    return rows.withColumn("status", coverage.status(F.col("labels_in_text"), F.col("missing")))


# -- sizes --------------------------------------------------------------------
def size_counts(raw: DataFrame) -> DataFrame:
    """(paper, size, n): long blocks by size; a paper without any has one row of no blocks."""
    long = F.length("text") > ingest.BODY_CHARS
    return raw.groupBy("paper", F.when(long, F.col("size")).alias("size")).agg(F.count_if(long).alias("n"))


def merge_counts(one: DataFrame, other: DataFrame) -> DataFrame:
    """(paper, size, n) of both."""
    return one.unionByName(other).groupBy("paper", "size").agg(F.sum("n").alias("n"))


def body_size(counts: DataFrame) -> DataFrame:
    """(paper, body): the rows of ``ingest.body_size``, the median read off the counts."""
    order = Window.partitionBy("paper").orderBy("size")
    rows = counts.where("size is not null").select("paper", "size", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("paper")).alias("all"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("size")))
    middle = rows.groupBy("paper").agg(((at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2).alias("body"))
    return counts.select("paper").distinct().join(middle, "paper", "left").select("paper", F.coalesce("body", F.lit(ingest.BODY_SIZE)).alias("body"))


def heading_candidates(raw: DataFrame) -> DataFrame:
    """(paper, seq, size) of blocks short enough for a heading: all that telling headings again needs."""
    return raw.where(F.length("text") <= ingest.HEADING_CHARS).select("paper", "seq", "size")


def headings(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(paper, seq) of the headings among the candidates, by the sizes of all blocks so far."""
    return candidates.join(body_size(counts), "paper").where(F.col("size") > F.col("body") * ingest.HEADING_RATIO).select("paper", "seq")
