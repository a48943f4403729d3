"""Sharding: size-tiered compaction under a versioned manifest.

Arrivals are appended as runs of small immutable Parquet shards, a folder each.
Runs of like size (one tier spans a factor of FANOUT) are merged, once there are
FANOUT of them, into one run of target-sized files; a run of target-sized files
is never merged again.  What is live is said by the newest manifest alone:
version v is a folder written aside and then renamed to its place, which fails
if another writer was first, so readers see all of a change or none of it.  The
manifest has a row for each run, with its files, bytes and schema: no file is
named or opened by the driver, and there are some FANOUT runs a tier.

A writer who was second tries again on the newer version; a merge whose runs
another writer has merged meanwhile is dropped.  ``vacuum`` spares what is
younger than a grace time, as another writer may be about to commit it, and a
commit fails if a run that it names is gone.

Any columns and types of Parquet pass through; nulls, repeated rows and columns
named as the manifest's are data like any other.  Runs of other columns are read
with all columns, absent ones as null; a column of two types is an error.  An
empty arrival adds a run of no rows; a store without a version reads as None.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Runs of a tier that are merged, and the factor between tiers.
FANOUT = 4
#: Bytes of a full file.
TARGET_BYTES = 256 << 20
#: Seconds for which a folder that no version names may yet be committed.
GRACE = 24 * 3600
TRIES = 20
_RUNS = "run string, files long, bytes long, schema string"


class Conflict(RuntimeError):
    """Another writer was first; nothing has changed."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        """A path in the store and its file system."""
        at = self._hadoop.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self._conf)

    def _list(self, name: str) -> list[tuple[str, float]]:
        """Names in a folder with the seconds since they changed; of runs and versions, never of a run's files."""
        at, fs = self._at(name)
        return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, name: str) -> None:
        at, fs = self._at(name)
        fs.delete(at, True)

    # -- manifest ---------------------------------------------------------
    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max((int(name[1:]) for name, _ in self._list("manifest") if name.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(run, files, bytes, schema) of a version's live runs."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], _RUNS)
        return self.spark.read.schema(_RUNS).parquet(f"{self.path}/manifest/v{v:08d}")

    def _commit(self, before: int, live: DataFrame) -> int:
        aside = f"aside/{uuid.uuid4().hex}"
        live.coalesce(1).write.parquet(f"{self.path}/{aside}")
        to, fs = self._at(f"manifest/v{before + 1:08d}")
        fs.mkdirs(to.getParent())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(to.toUri(), self._conf).rename(self._at(aside)[0], to, none)
        except Exception as e:
            self._delete(aside)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {before + 1} exists") from e
            raise
        return before + 1

    def _change(self, add: list[Row], drop: frozenset[str] = frozenset()) -> int:
        """Commit runs that come and go on the newest version, again if another writer was first."""
        for _ in range(TRIES):
            before = self.version()
            live = self.manifest(before).collect()  # a row a run
            if drop - {r["run"] for r in live}:
                raise Conflict("another writer has merged these runs")
            for r in add:
                at, fs = self._at(f"{r['run']}/_SUCCESS")
                if not fs.exists(at):
                    raise Conflict(f"{r['run']} is gone")
            try:
                return self._commit(before, self.spark.createDataFrame([*(r for r in live if r["run"] not in drop), *add], _RUNS))
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other writers were first")

    # -- runs -------------------------------------------------------------
    def _write_run(self, rows: DataFrame) -> Row:
        run = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{run}")
        at, fs = self._at(f"{run}/_SUCCESS")
        if not fs.exists(at):
            fs.create(at).close()  # where the session writes no mark of its own
        held = fs.getContentSummary(self._at(run)[0])
        return Row(run=run, files=held.getFileCount() - 1, bytes=held.getLength(), schema=rows.schema.json())

    def append(self, rows: DataFrame) -> int:
        """Commit an arrival as a run of small shards; its version."""
        return self._change([self._write_run(rows)])

    def _due(self, live: list[Row]) -> list[list[Row]]:
        """Groups of runs to merge: FANOUT or more of one tier, none of full files; once there are none, runs of more files than their bytes fill, each alone."""
        tiers, small = defaultdict(list), [r for r in live if r["bytes"] / max(r["files"], 1) < self.target / 2]
        for r in small:
            tiers[int(math.log(max(r["bytes"], 1), self.fanout))].append(r)
        groups = [sorted(group, key=lambda r: r["run"]) for group in tiers.values() if len(group) >= self.fanout]
        # each such merge leaves fewer files, so it comes to an end
        return groups or [[r] for r in small if r["files"] > self._full(r["bytes"])]

    def _full(self, size: int) -> int:
        return max(1, math.ceil(size / self.target))

    def compact(self) -> int:
        """Merge until no tier holds FANOUT runs and no run more small files than it needs; the version then live."""
        while True:
            before = self.version()
            due = self._due(self.manifest(before).collect())
            if not due:
                return before
            # neighbouring splits go to one file each: no shuffle
            merged = [self._write_run(self._rows(group).coalesce(self._full(sum(r["bytes"] for r in group)))) for group in due]
            try:
                self._change(merged, frozenset(r["run"] for group in due for r in group))
            except Conflict:
                for r in merged:
                    self._delete(r["run"])

    def _rows(self, runs: list[Row]) -> DataFrame:
        fields = {}
        for r in runs:
            for f in StructType.fromJson(json.loads(r["schema"])):
                if fields.setdefault(f.name, f).dataType.simpleString() != f.dataType.simpleString():
                    raise ValueError(f"column {f.name} has two types")
        return self.spark.read.schema(StructType(list(fields.values()))).parquet(*(f"{self.path}/{r['run']}" for r in runs))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None before the first."""
        v = self.version() if version is None else version
        return self._rows(self.manifest(v).orderBy("run").collect()) if v else None

    def vacuum(self, keep: int = 2, grace: float = GRACE) -> None:
        """Drop all but the newest ``keep`` versions, and folders of more than ``grace`` seconds that none of those names."""
        runs = [(name, age) for name, age in self._list("") if name.startswith("run-")]  # before the versions: what is committed meanwhile is not seen as spare
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        live = {r["run"] for v in kept for r in self.manifest(v).select("run").collect()}
        for name, _ in self._list("manifest"):
            if name.startswith("v") and int(name[1:]) <= last and int(name[1:]) not in kept:
                self._delete(f"manifest/{name}")
        spare = [(name, age) for name, age in runs if name not in live] + [(f"aside/{name}", age) for name, age in self._list("aside")]
        for name, age in spare:
            if age >= grace:
                self._delete(name)


def arrivals(rows: DataFrame, order_col: str, n: int) -> list[DataFrame]:
    """``rows`` cut into n arrivals along a numeric column; nulls come first.  The ranges are pushed to the scan."""
    low, high = rows.agg(F.min(order_col), F.max(order_col)).first()
    if low is None:
        return [rows]
    cuts = [low + (high + 1 - low) * k // n for k in range(1, n)]
    c = F.col(order_col)
    ends = [None, *cuts, None]
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        part = rows if b is None else rows.where(c.isNull() | (c < b) if a is None else c < b)
        out.append(part if a is None else part.where(c >= a))
    return out
