"""All queries of the core, by name, and the SQL that the ones expressible in it are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import extract_queries, graph_queries, skew_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (graph_queries, extract_queries, text_queries, skew_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
