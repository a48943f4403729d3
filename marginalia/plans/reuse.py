"""Reuse by content: a stage runs again for the papers whose inputs have changed, and for no other.

A paper's key at a stage is the digest of the stage's name and version, of its
template, and of the paper's inputs: contents of tables, or the keys of earlier
stages.  So keys form a tree, and a changed block changes its own paper's keys
from there on.  Results are stored under their key, a version a run, never
changed; what is read is that of the present key, so going back to an earlier
input finds its old results.

Contents are digested in two levels, so that no task meets all rows of a paper:
rows into PARTS by their own digest, parts into the paper.  The order of rows
doesn't count, their number does; a column that is added changes the digest.  A
paper without rows of an input has that input's empty digest.  A paper whose
stage gives no rows is done all the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import seams

PARTS = 256


def content(rows: DataFrame, key: str = "paper") -> DataFrame:
    """(paper, digest) of all rows of each paper."""
    rest = sorted(c for c in rows.columns if c != key)
    own = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    each = rows.select(key, own.alias("d"))
    parts = each.groupBy(key, F.pmod(F.xxhash64("d"), F.lit(PARTS)).alias("part")).agg(joined("d").alias("d"))
    return parts.groupBy(key).agg(joined("d").alias("digest"))


def keys(papers: DataFrame, stage: str, version: str, inputs: dict[str, DataFrame], template: str = "") -> DataFrame:
    """(paper, key) of every paper; inputs by name: (paper, digest), as of ``content``, or (paper, key) of an earlier stage."""
    rows = papers.select("paper").distinct()
    parts: list[Column] = [F.lit(stage), F.lit(version), F.sha2(F.lit(template), 256)]
    for name, digests in sorted(inputs.items()):
        value = next(c for c in ("digest", "key") if c in digests.columns)
        rows = rows.join(digests.select("paper", F.col(value).alias(f"of_{name}")), "paper", "left")
        parts += [F.lit(name), F.coalesce(f"of_{name}", F.lit(""))]
    return rows.select("paper", F.sha2(F.concat_ws("|", *parts), 256).alias("key"))


def states(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """(paper, key, state) of papers: ``same`` where the key is done, ``changed`` where only others of the paper are, else ``new``."""
    known = done.groupBy("paper").agg(F.lit(True).alias("known"))
    rows = wanted.join(done.select("paper", "key", F.lit(True).alias("hit")).distinct(), ["paper", "key"], "left").join(known, "paper", "left")
    return rows.select("paper", "key", F.when(F.col("hit"), "same").when(F.col("known"), "changed").otherwise("new").alias("state"))


class Store:
    """Results of stages in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, stage: str, what: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{stage}/*/{what}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def done(self, stage: str) -> DataFrame:
        """(paper, key) of all that the stage has ever been run for."""
        rows = self._read(stage, "keys")
        return self.spark.createDataFrame([], "paper string, key string") if rows is None else rows

    def run(self, stage: str, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stage's rows for the papers and keys ``wanted``; ``make`` gets the (paper) that it has to be run for."""
        done = self._read(stage, "keys")
        stale = wanted if done is None else wanted.join(done, ["paper", "key"], "left_anti")
        stale = seams.kept(stale.select("paper", "key"))
        if done is None or not stale.isEmpty():
            made = make(stale.select("paper"))
            aside = f"{self.path}/_making/{stage}-{uuid.uuid4().hex}"
            made.join(stale, "paper").write.parquet(f"{aside}/rows")
            stale.write.parquet(f"{aside}/keys")
            seams.move(self.spark, aside, f"{self.path}/{stage}/{uuid.uuid4().hex}")
        return self._read(stage, "rows").join(wanted.select("paper", "key"), ["paper", "key"], "left_semi").drop("key")


def stale_stages(chain: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(paper, stage, key, state) over stages in order: name to (wanted, done)."""
    return reduce(DataFrame.unionByName, (states(wanted, done).withColumn("stage", F.lit(name)) for name, (wanted, done) in chain.items()))
