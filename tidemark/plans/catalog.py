"""All registered queries of the analytics engine and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import clicks, ingest, quality, requirements, sources, stats, text, upkeep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (stats, clicks, quality, ingest, text, requirements, sources, upkeep):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
