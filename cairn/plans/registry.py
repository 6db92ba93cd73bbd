"""Named queries: the DataFrame, an independent SQL statement, and the inventory rows that each covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        COVERS[name] = covers.split()
        if sql:
            ORACLE[name] = sql
        return f

    return add


def covered() -> dict[str, list[str]]:
    """Inventory row → the queries that cover it."""
    out: dict[str, list[str]] = {}
    for name, rows in COVERS.items():
        for r in rows:
            out.setdefault(r, []).append(name)
    return out
