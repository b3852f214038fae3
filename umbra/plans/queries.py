"""Queries of the core operators, by name, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from umbra.plans import model_queries, more_queries, nested_queries, span_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (text_queries, span_queries, model_queries, nested_queries, more_queries)
QUERIES: dict[str, Query] = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
