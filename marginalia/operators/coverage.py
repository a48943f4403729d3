"""Which citation labels of a text its checked claims cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import by_number, labels_in_text


def covered_labels(claims: DataFrame) -> DataFrame:
    """(paper, cited): distinct labels that claims cite."""
    labels = claims.select("paper", F.explode("refs").alias("label")).distinct()
    return labels.groupBy("paper").agg(F.collect_set("label").alias("cited"))


def text_labels(texts: DataFrame) -> DataFrame:
    """(paper, labels_in_text) of texts (paper, clean_md)."""
    return texts.select("paper", labels_in_text(F.col("clean_md")).alias("labels_in_text"))


def cited() -> Column:
    """Distinct labels that a group of claims cites."""
    return F.array_distinct(F.flatten(F.collect_set("refs")))


def parted(labels: Column, cited: Column) -> dict[str, Column]:
    """``covered`` and ``missing`` of a text's labels; cited may be null."""
    known = F.coalesce(cited, F.array().cast("array<string>"))
    return {"covered": by_number(F.array_intersect(labels, known)), "missing": by_number(F.array_except(labels, known))}


def status(labels: Column, missing: Column) -> Column:
    return F.when(F.size(labels) == 0, "not audited").when(F.size(missing) > 0, "missing").otherwise("all covered")


def coverage_audit(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """(paper, labels_in_text, covered, missing, status) of texts (paper, clean_md).

    Labels are found within each row; only the short label arrays meet the
    claims, so the texts are not shuffled.
    """
    rows = text_labels(texts).join(covered_labels(claims), "paper", "left")
    rows = rows.select("paper", "labels_in_text", *(c.alias(k) for k, c in parted(F.col("labels_in_text"), F.col("cited")).items()))
    return rows.withColumn("status", status(F.col("labels_in_text"), F.col("missing")))


def label_rows(texts: DataFrame) -> DataFrame:
    """(paper, label), one row each."""
    return texts.select("paper", F.explode(labels_in_text(F.col("clean_md"))).alias("label"))


def covered_rows(texts: DataFrame, claims: DataFrame, how: str) -> DataFrame:
    """Labels with a claim (left_semi) or without one (left_anti)."""
    cited = claims.select("paper", F.explode("refs").alias("label"))
    return label_rows(texts).join(cited, ["paper", "label"], how)
