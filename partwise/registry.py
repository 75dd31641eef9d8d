"""Queries of the matrix engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partwise.plans import analyses  # noqa: F401  (registers its queries)
from partwise.plans.queries import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Callables ``(spark, sf_dir) -> DataFrame`` by query name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(SQL)
