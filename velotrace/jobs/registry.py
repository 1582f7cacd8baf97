"""Registry of the ride queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, sf_dir)`` under its name, with the same query for DuckDB."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles that come from sums differ in their last bits between engines.

    The power of ten is multiplied in before the rounding, as DuckDB does;
    ``F.round`` rounds the shortest decimal form, which may lie on the other side of a half.
    """
    kinds, power = dict(df.dtypes), 10.0**digits
    return df.withColumns({c: F.round(F.col(c) * power) / power if kinds[c] == "double" else F.round(c, digits) for c in columns})
