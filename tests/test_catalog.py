"""Every query with SQL gives the SQL's rows."""

import pytest
from compare import duck_rows, spark_rows

from marginalia import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, name):
    found, wanted = spark_rows(catalog.queries()[name](spark, small)), duck_rows(SQL[name], small)
    assert found[0] == wanted[0]
    assert found[1] == wanted[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["paper", "labels_in_text", "covered", "missing", "status"]


def test_names_need_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 100"], check=True)


def test_joins_are_equi_joins(spark, small):
    for name in ("J6_provided", "J7_uncited", "J9_phrase_hits"):
        plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
