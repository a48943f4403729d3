"""The folder that driver and executors share, and tables cut off from their lineage in it.

A table is written as it is, with any columns, nulls and repeated rows; an
empty one keeps its columns and types.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a folder of this process on one machine, and an error on a cluster."""
    set_to = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marginalia/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later stages and lost executors start from the files.

    Inside ``temporary`` it lasts until the end of the block; with ``keep``
    until that of the block around it, or for good.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables made in the block go at its end; what is to outlast it is made with ``keep``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop_path(spark, path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Tables made in the block give back the disk of their shuffles once they are written, not when memory happens to be cleaned up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
