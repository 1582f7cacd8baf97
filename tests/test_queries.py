"""Registered queries against DuckDB on the smallest tables; corpus queries are tested in their own folder."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from velotrace import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame) -> list[str]:
    one = lambda v: "-" if pd.isna(v) else f"{float(v) + 0.0:.5f}" if not isinstance(v, str) else v
    return sorted("|".join(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(jobs.QUERIES))
def test_query(spark, duck, name):
    got = jobs.QUERIES[name](spark, SF).toPandas()
    if name in jobs.ORACLE_SQL:
        want = duck.sql(jobs.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
