"""A stored positional index of pages: for each word of a page its places, sorted.

Postings are bucketed by all that a lookup joins on, so words of a phrase meet
them without a shuffle of the index, and words of pages that no claim names are
never moved again once they are stored.  Appended pages are further files;
nothing that is there is rewritten.  Another session opens the folder again.

A page is appended whole and once: words of pages that the index holds already
are left out, so a repeated append adds nothing.  Null words are no words.  A
word is indexed in lower case.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seams

PAGE = ["paper", "slug", "page"]
KEYS = [*PAGE, "word"]
HITS = "array<struct<pos:int,x0:double,y0:double,x1:double,y1:double>>"


def postings(words: DataFrame) -> DataFrame:
    """(paper, slug, page, word, hits) of words (paper, slug, page, pos, word, x0, y0, x1, y1)."""
    place = F.struct(F.col("pos").cast("int").alias("pos"), "x0", "y0", "x1", "y1")
    rows = words.where("word is not null").select(*PAGE, F.lower("word").alias("word"), place.alias("hit"))
    return rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list("hit")).alias("hits"))


class PageIndex:
    """The index in a folder; ``buckets`` and the papers' type are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200, paper: str = "string"):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            buckets, paper = spark.read.schema("buckets int, paper string").parquet(f"{self.path}/_made").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            spark.createDataFrame([(buckets, paper)], "buckets int, paper string").coalesce(1).write.parquet(f"{self.path}/_made")
        self.buckets = buckets
        self.name = "page_index_" + hashlib.md5(self.path.encode()).hexdigest()
        keys = ", ".join(KEYS)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (paper {paper}, slug string, page int, word string, hits {HITS}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, words: DataFrame) -> None:
        """Postings of pages that are new, as files of their own."""
        known = self.table().select(*PAGE).distinct()
        if not known.isEmpty():
            words = words.join(known, PAGE, "left_anti")
        # dealt to the buckets once, as words in lower case: their postings and the files are made where they are
        dealt = words.withColumn("word", F.lower("word")).repartition(self.buckets, *KEYS)
        postings(dealt).select(*self.table().columns).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Take the folder away."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        seams.remove(self.spark, self.path)
