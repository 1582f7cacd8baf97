"""Registered queries of the library."""

from . import history_queries, series_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "history_queries", "series_queries"]
