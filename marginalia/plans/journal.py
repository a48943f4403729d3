"""A journal of a retrieval: what each stage has found of each reference, appended and never changed.

A stage's facts of the references that it hasn't seen are made, written aside,
and renamed into the stage's next version; what it has seen it reads.  So a run
that is lost between two services, or within one, goes on from the facts, in a
new session too, and asks nothing twice; references that arrive later are a
further version.  The present state of a reference is derived from its facts.

One writer at a time: if another took a version first, the write fails and can
be run again.  A reference without a result has a fact that says so.

Facts repeat themselves, so their files are small for their rows; joins by
reference are merges, as a broadcast chosen by the files' size would pass the
driver all references.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import seams

KEY = ["paper", "ord"]


class Journal:
    """The journal in a folder that driver and executors share; ``stages``: their names in the order of the chain."""

    def __init__(self, spark: SparkSession, path: str, stages: tuple[str, ...] = ()):
        self.spark, self.path, self.stages = spark, path.rstrip("/"), stages

    def _read(self, stage: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{stage}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def facts(self, stage: str) -> DataFrame | None:
        """(paper, ord, version, found, fact) of a stage; None where nothing is written yet."""
        rows = self._read(stage)
        return rows if rows is None else rows.select(*KEY, F.col("version").cast("int").alias("version"), F.col("fact").isNotNull().alias("found"), "fact")

    def advance(self, stage: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``make`` of the rows (paper, ord, …): read for those that the stage has seen, made and appended for the others."""
        rows, known = seams.kept(rows), self._read(stage)  # used several times below
        new = rows if known is None else rows.join(known.select(*KEY).hint("merge"), KEY, "left_anti")
        if known is None or not new.isEmpty():
            self._append(stage, new, make(new), known)
        facts = self._read(stage).where("fact is not null")
        return facts.join(rows.select(*KEY).distinct().hint("merge"), KEY, "left_semi").select(*KEY, "fact.*").hint("merge")

    def _append(self, stage: str, rows: DataFrame, made: DataFrame, known: DataFrame | None) -> None:
        rest = [c for c in made.columns if c not in KEY]
        facts = rows.select(*KEY).distinct().join(made.select(*KEY, F.struct(*rest).alias("fact")), KEY, "left")
        version = 0 if known is None else known.agg(F.max("version")).first()[0] + 1
        aside, place = f"{self.path}/_making/{stage}-{uuid.uuid4().hex}", f"{self.path}/{stage}/version={version}"
        facts.write.parquet(aside)
        seams.move(self.spark, aside, place)

    def history(self) -> DataFrame:
        """(paper, ord, stage, version, found): every fact of every stage."""
        parts = [f.select(*KEY, F.lit(k).alias("at"), F.lit(s).alias("stage"), "version", "found") for k, s in enumerate(self.stages) if (f := self.facts(s)) is not None]
        return reduce(DataFrame.unionByName, parts).select(*KEY, "stage", "version", "found", "at")

    def present(self) -> DataFrame:
        """(paper, ord, stage, version, found): how far each reference has come."""
        last = self.history().groupBy(*KEY).agg(F.max_by(F.struct("stage", "version", "found"), "at").alias("l"))
        return last.select(*KEY, "l.*")
