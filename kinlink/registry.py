"""Every query of the library with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import blocking_queries, pair_queries, report_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    assert blocking_queries and pair_queries and report_queries  # importing them registers their queries
    return dict(text_queries.Q)


def oracle_sql() -> dict[str, str]:
    return dict(text_queries.O)
