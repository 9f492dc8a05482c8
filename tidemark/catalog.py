"""The registered queries of the series engine and the SQL that must give the same rows."""

from tidemark.plans import event_queries, series_queries, sheet_queries  # noqa: F401
from tidemark.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
