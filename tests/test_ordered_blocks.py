"""Blocks keep the order in which they were numbered: their texts are neither shuffled nor sorted."""

import re

import pytest
from compare import spark_rows

from marginalia import catalog
from marginalia.operators import ingest as I
from marginalia.plans import derived as D


@pytest.mark.parametrize("name", ["F25_rendered", "S1_flat_blocks"])
def test_blocks_are_dealt_out_and_sorted_once(spark, small, name):
    plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\((?!p_partkey|l_partkey)", plan)) == 1
    assert len(re.findall(r"Sort \[(?!p_partkey|l_partkey)", plan)) == 1


def test_ordered_blocks_are_the_raw_blocks(spark, small):
    rows, order = D.ordered_blocks(spark, small)
    assert order == ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    raw = D.raw_blocks(spark, small)
    assert spark_rows(rows.select(*raw.columns)) == spark_rows(raw)
    assert spark_rows(I.flat_blocks(rows, order)) == spark_rows(I.flat_blocks(raw))
