"""All queries of the core, with the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import queries_evidence, queries_lifecycle, queries_metrics, queries_retrieval, queries_runs, queries_scopes, queries_snapshots, queries_text

_MODULES = (queries_retrieval, queries_lifecycle, queries_evidence, queries_metrics, queries_runs, queries_snapshots, queries_text, queries_scopes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
