"""A training corpus from ``documents``: filter, deduplicate, redact, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
their columns; its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe, mixing, ngram_join, quality_classifier, secret_scan
from marginalia.llm.registry import WEIGHTS
from marginalia.llm.store import drop_path, new_path, read, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking classifier accepts."""
    return quality_classifier.select_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return ngram_join.first_of_each(docs, n=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` counted anew."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files in the order of the mixture."""
    whole = docs.select("doc_id", "source", F.struct(*docs.columns).alias("row"))  # a column named as one of the mixture's stays as it is
    return mixing.in_order(mixing.mix(whole, WEIGHTS)).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, whether they decode to its text, and its place in the mixture, in files in that order.

    The place is worked out anew, as files that are read again come in any order.
    """
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    mixed = mixing.in_order(mixing.mix(docs.select("doc_id", "source", "text"), WEIGHTS)).select(F.struct("mix_slot", "mix_within", "doc_id").alias("place"), "text")
    rows = byte_bpe.round_trip(mixed, path, pattern, id_col="place")
    return rows.select("place.*", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", quality), ("ngram_join", near_duplicates), ("secret_scan", secrets), ("mixing", mixture), ("byte_bpe", tokens)]

#: A learnt classifier and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, in the order of the mixture; what a stage wrote for itself or for the next goes once that is done."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs.orderBy("mix_slot", "mix_within")
