"""Where the files of a paper's audit lie."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The layout of a case.
FOLDERS = ("sources", "form", "ingest", "out/evidence")
SOURCE_MAP, CLEAN, ANNOTATED = "ingest/{0}/source_map.json", "ingest/{0}/clean.md", "ingest/{0}/annotated.md"
MANIFEST, RESULTS, SCOUT, RESOLVED = "refs_manifest.json", "out/results.json", "out/scout.json", "sources_resolved/{0}.pdf"


def paths(document: Column, slug: Column) -> dict[str, Column]:
    """Where the files of a document and of a source lie within its case."""
    filled = lambda pattern, value: F.format_string(pattern.replace("{0}", "%s"), value)
    per_document = {"source_map": SOURCE_MAP, "clean": CLEAN, "annotated": ANNOTATED}
    return {k: filled(v, document) for k, v in per_document.items()} | {"resolved": filled(RESOLVED, slug)} | {k: F.lit(v) for k, v in (("manifest", MANIFEST), ("results", RESULTS), ("scout", SCOUT))}


def init(spark: SparkSession, case: str) -> list[str]:
    """Make the folders of a case on whatever file system its path names; those that were missing."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    made = []
    for name in FOLDERS:
        at = hadoop.Path(f"{case.rstrip('/')}/{name}")
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            fs.mkdirs(at)
            made.append(name)
    return made
