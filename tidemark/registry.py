"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.adapters import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None, *uses: str) -> Callable[[Query], Query]:
    """Register a query; body is its oracle, which reads the adapters named in uses."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if body:
            ORACLES[name] = sql(body, *uses)
        return f

    return put
