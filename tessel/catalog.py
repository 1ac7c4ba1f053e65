"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import annotation, functions, splitting, strategies, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _registry in (functions.R, splitting.R, tables.R, annotation.R, strategies.R):
    QUERIES |= _registry.queries
    ORACLE_SQL |= _registry.sql
FLAGSHIP = "flagship"
