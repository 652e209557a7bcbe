"""Queries by name for the driver: each takes (spark, sf_dir); SQL gives the same result in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reportloom.plans import audits, benchmark, documents, general, graphs, quality, resolution, retrieval, texts

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (general, texts, retrieval, graphs, audits, quality, resolution, benchmark, documents)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
