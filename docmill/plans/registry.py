"""Queries over the test tables and their DuckDB twins, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.plans import catalog, chunks, lexical, operations, retrieval, services, texts

MODULES = (lexical, retrieval, texts, chunks, operations, catalog, services)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLE: dict[str, str] = {n: s for m in MODULES for n, s in m.ORACLE.items()}
