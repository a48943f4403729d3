"""Reports are files a portion at a time, and packed before and after."""

import os

from compare import duck_rows, spark_rows

from marginalia import catalog
from marginalia.plans import catalog_tables as T
from marginalia.sources import case_sink, seams

NAME = "K4_report_files"


def size(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(path) for f in names)


def test_files_of_a_portion_go_before_the_next(spark, small, monkeypatch):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several files
    wrote, removed, own, gone = [], [], case_sink.write_files, seams.remove

    def write(files, root):
        assert not any(os.path.exists(r) for r in wrote)
        wrote.append(root)
        return own(files, root)

    def remove(s, path):
        removed.append(size(path))
        gone(s, path)

    monkeypatch.setattr(case_sink, "write_files", write)
    monkeypatch.setattr(seams, "remove", remove)
    monkeypatch.setattr(T, "PORTION_BYTES", 400_000)
    try:
        rows = spark_rows(catalog.queries()[NAME](spark, small))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert rows == duck_rows(catalog.oracle_sql()[NAME], small)
    texts = sum(r[rows[0].index("n_bytes")] for r in rows[1])
    assert len(wrote) > 1 and max(removed) < texts / 2 and removed[-1] < texts / 2


def test_what_is_kept_of_the_reports_is_packed(spark, small):
    rows = catalog.queries()[NAME](spark, small)
    texts = rows.selectExpr("sum(n_bytes)").first()[0]
    kept = sum(os.path.getsize(f.removeprefix("file://")) for f in rows.inputFiles())
    assert 0 < kept < texts / 3
