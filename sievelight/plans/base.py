"""Registration of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.stand_in import FINDINGS_SQL, ORGS_SQL, TRANSITIONS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_WITH = {"findings": FINDINGS_SQL, "orgs": ORGS_SQL, "requests": TRANSITIONS_SQL}


def query(name: str, sql: str | None = None, uses: str = "") -> Callable:
    """Register a query; ``uses`` names the shared views that its oracle starts with."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = ("WITH RECURSIVE " + ", ".join(_WITH[u] for u in uses.split()) + " " + sql) if uses else sql
        return f

    return add
