"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.plans import match_queries, ml_queries, panel_queries, source_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**panel_queries.QUERIES, **match_queries.QUERIES, **ml_queries.QUERIES, **source_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**panel_queries.SQL, **match_queries.SQL, **ml_queries.SQL, **source_queries.SQL}
