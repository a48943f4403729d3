"""Queries with SQL give its rows on tables with what the driver's small ones lack."""

import os

import pyarrow.parquet as pq
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from marginalia import catalog


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    """The small tables, with customers whose only order has no lines."""
    root = tmp_path_factory.mktemp("odd")
    for name in os.listdir(small):
        os.symlink(f"{small}/{name}", root / name)
    orders = spark.read.parquet(f"{small}/orders.parquet")
    bare = orders.limit(3).withColumns({c: (F.col(c) + 10_000_000).cast(orders.schema[c].dataType) for c in ("o_orderkey", "o_custkey")})
    os.unlink(root / "orders.parquet")
    pq.write_table(orders.unionByName(bare).toArrow(), root / "orders.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["K1_results_json", "S4_results_runs", "K4_report", "K8_console", "K4b_page_rows", "A11_coverage_bits", "coverage_audit"])
def test_papers_without_claims(spark, odd, name):
    assert spark_rows(catalog.queries()[name](spark, odd)) == duck_rows(catalog.oracle_sql()[name], odd)
