"""All queries of the citation-audit operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog_tables, catalog_text

Query = Callable[[SparkSession, str], DataFrame]
_ALL = catalog_text.QUERIES | catalog_tables.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
