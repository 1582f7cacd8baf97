"""Distances and means that lie on a half or next to one, against DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from velotrace import jobs
from velotrace.jobs.registry import rounded
from velotrace.operators import segments, summary

#: Of these kilometres (price / 10,000) most are stored as a little less or more than the half that they look like.
KM = (2.05, 3.05, 5.35, 37.65, 0.25, 12.75, 1.15, 40.0)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Two athletes with four rides a day apart, all of them analysed; DuckDB on the same tables."""
    d, c = str(tmp_path_factory.mktemp("halves")), duckdb.connect()
    rides = ", ".join(f"({i + 1}, {i % 2}, {km} * 10000, TIMESTAMP '1995-01-01' + INTERVAL {20 * i} DAY)" for i, km in enumerate(KM))
    c.execute(f"CREATE TABLE orders AS SELECT a::BIGINT AS o_orderkey, b::BIGINT AS o_custkey, round(c, 2)::DOUBLE AS o_totalprice, d::TIMESTAMP AS o_orderdate FROM (VALUES {rides}) t(a, b, c, d)")
    c.execute("CREATE TABLE documents AS SELECT o_orderkey AS doc_id, ' Ride ' || o_orderkey AS text, 'en' AS lang FROM orders")
    c.execute("CREATE TABLE conversations AS SELECT o_orderkey AS conv_id, 0::BIGINT AS turn, 'user' AS role, 'Why?' AS text FROM orders WHERE o_orderkey % 2 = 0")
    for t in ("orders", "documents", "conversations"):
        c.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return d, c


@pytest.mark.parametrize("name", ["h17_t8_fields_and_labels", "t4_recent_history_text", "t7_context_document"])
def test_distances_as_sql_prints_them(spark, tables, name):
    d, c = tables
    got = {r["activity_id"]: r.asDict() for r in jobs.QUERIES[name](spark, d).collect()}
    names = list(next(iter(got.values())))
    want = c.execute(f"SELECT {', '.join(names)} FROM ({jobs.ORACLE_SQL[name]})").fetchall()
    assert got == {w[names.index("activity_id")]: dict(zip(names, w)) for w in want}


#: The mean of the first 20 is 2.85, which sums from either end miss on either side.
SPEEDS = (1.887, 3.8329999999999997, 2.391, 1.3679999999999999, 4.514, 1.736, 1.943, 4.755, 0.0, 5.901, 3.371, 1.672, 0.325, 4.1450000000000005, 0.238, 1.042, 0.0, 4.5280000000000005, 2.324, 11.027)


def added(values) -> float:
    total = 0.0
    for v in values:
        total += v
    return total


def test_rounding_on_halves_as_duckdb_rounds(spark):
    made = [(i, i / 100 / n) for n in (32, 64, 96) for i in range(200_001, 200_801)]
    got = rounded(spark.createDataFrame(made, "i long, x double").select("i", "x", F.col("x").alias("r")), "r").collect()
    c = duckdb.connect()
    want = dict(c.execute("SELECT x, round(x, 6) FROM (SELECT unnest(?) AS x)", [[x for _, x in made]]).fetchall())
    assert all(r["r"] == want[r["x"]] for r in got)
    assert rounded(spark.sql("SELECT 5L AS r"), "r").first()["r"] == 5


def test_summary_means_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, i, i * 1000, i * 1.0, i * 0.01, v, 120.0, 100.0, 80.0, v) for i, v in enumerate(SPEEDS)]
    names = "activity_id long, record_index long, elapsed_ms long, elapsed_s double, distance_km double, speed_kmh double, heart_rate double, altitude_m double, cadence double, power double"
    context = spark.createDataFrame([(1, 200.0, 50.0, 190.0, "male")], "activity_id long, ftp double, rest_hr double, top_hr double, sex string")
    turned = spark.createDataFrame(rows[::-1], names).coalesce(1)
    assert added(SPEEDS) != added(SPEEDS[::-1])
    assert summary.activity_summary(turned, context).first()["avg_power"] == added(SPEEDS) / 20


def test_segment_mean_on_a_half_is_added_from_the_last_record(spark):
    rows = [(1, i, i * 1.0, v, 120.0, v, 0.0, 100.0, "low") for i, v in enumerate(SPEEDS)]
    prepared = spark.createDataFrame(rows, "activity_id long, record_index long, elapsed_s double, speed_kmh double, heart_rate double, power double, grade_pct double, alt_smooth double, confidence string")
    parts = spark.createDataFrame([(1, 0, 19, "flat", "power")], "activity_id long, start_index long, end_index long, terrain string, effort_basis string")
    got = segments.segment_summary(prepared, parts).first()
    assert got["avg_speed_kmh"] == math.floor(added(SPEEDS[::-1]) / 20 * 10 + 0.5) / 10 == 2.8
    assert got["elev_gain_m"] == 0
