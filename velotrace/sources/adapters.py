"""Canonical ride tables derived from the supplied star-schema tables.

Each adapter is one projection (plus one window for the record order), with
integer arithmetic wherever possible so that another engine gets equal bits.
``*_SQL`` hold the same derivations for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records_select(us: str, div: str, k: str) -> str:
    return f"""
SELECT activity_id, record_index, elapsed_ms, elapsed_ms / 1000.0D AS elapsed_s, record_index * 0.03D + k * 0.0001D AS distance_km,
  CASE WHEN k % 10 = 0 THEN 0.0D ELSE value / 10.0D END AS speed_kmh, CASE WHEN k % 17 = 0 THEN NULL ELSE 90.0D + k END AS heart_rate,
  100.0D + abs(record_index % 40 - 20) * 2.0D + k % 3 AS altitude_m,
  CASE WHEN event_type = 'error' THEN 0.0D ELSE 52.0D + record_index * 0.0003D END AS position_lat,
  CASE WHEN event_type = 'error' THEN 0.0D ELSE 21.0D + (k % 7) * 0.00001D END AS position_long,
  k % 100 * 1.0D AS cadence, CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS power, k % 40 * 1.0D AS temperature
FROM (
  SELECT user_id AS activity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS record_index,
    ({us} - min({us}) OVER (PARTITION BY user_id)) {div} 20000000 AS elapsed_ms, event_type, value, {k} AS k
  FROM events) t
"""


#: The DuckDB forms. A literal such as 0.03D is Spark's double.
RECORDS_SQL = re.sub(r"(\d)D\b", r"\1::DOUBLE", _records_select("epoch_us(ts)", "//", "CAST(json_extract_string(props, '$.k') AS INTEGER)"))

#: Rides at a steady speed, whose fixes, distances and speeds agree but for every fourth ride's wheel.
_STEADY = """
SELECT activity_id, record_index, elapsed_ms, elapsed_s, v * elapsed_s / 3600 * (1 + activity_id % 5 * 0.01{d}) AS distance_km,
  v * (1 + (k % 3 - 1) * 0.01{d}) * CASE WHEN activity_id % 4 = 3 THEN 1.3{d} ELSE 1.0{d} END AS speed_kmh, heart_rate, altitude_m,
  CASE WHEN k % 23 = 0 THEN 0.0{d} ELSE 52.0{d} + v * elapsed_s / 3600 / 111.0{d} END AS position_lat, CASE WHEN k % 23 = 0 THEN 0.0{d} ELSE 21.0{d} END AS position_long,
  cadence, power, temperature
FROM (SELECT *, 25.0{d} + activity_id % 10 AS v, CAST(cadence AS INT) AS k FROM records) t
"""
STEADY_SQL = _STEADY.format(d="::DOUBLE")

#: Rides of real length: every sample's power, four times as high, is held for a minute of one-second rows (none counts as coasting).
_HELD = """
SELECT activity_id, record_index * 60 + s AS record_index, (record_index * 60 + s) * 1000 AS elapsed_ms, (record_index * 60 + s) * 1.0{d} AS elapsed_s, coalesce(power, 0.0{d}) * 4 AS power
FROM records, {seconds}
"""
HELD_SQL = _HELD.format(d="::DOUBLE", seconds="range(60) AS seconds(s)")

_ACTIVITIES = """
SELECT activity_id, athlete_id, {ts} AS start_ts, secs AS start_s, 'rides/' || CAST(activity_id AS {text}) || '.fit' AS file_path,
  CASE activity_id % 3 WHEN 0 THEN 'cycling' WHEN 1 THEN 'road_biking' ELSE 'running' END AS sport,
  total_distance_km, total_distance_km * 120 + activity_id % 600 AS total_timer_s,
  CASE WHEN activity_id % 7 = 0 THEN 0 ELSE 20 + activity_id % 15 END * one AS avg_speed_kmh, (40 + activity_id % 25) * one AS max_speed_kmh,
  (110 + activity_id % 50) * one AS avg_hr, CASE WHEN activity_id % 11 = 0 THEN 125 * one END AS manual_avg_hr,
  (150 + activity_id % 40) * one AS max_hr, activity_id % 900 * one AS total_ascent_m,
  CASE WHEN activity_id % 17 = 0 THEN 185 * one END AS manual_max_hr, CASE WHEN activity_id % 13 = 0 THEN 70 * one END AS rider_mass_kg,
  CASE WHEN activity_id % 19 = 0 THEN 11 * one END AS bike_mass_kg, activity_id % 3 * 1000 + activity_id AS imported_s
FROM (
  SELECT o_orderkey AS activity_id, o_custkey AS athlete_id, o_totalprice / 10000 AS total_distance_km, CAST(1 AS DOUBLE) AS one,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 1577836800 + {days} * 4320 END AS secs
  FROM orders) t
"""
ACTIVITIES_SQL = _ACTIVITIES.format(ts="make_timestamp(secs * 1000000)", text="VARCHAR", days="date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))")

_PROFILES = """
SELECT athlete_id, effective_day, 180 + max(activity_id) % 20 AS max_hr,
  CASE WHEN max(activity_id) % 2 = 0 THEN 120 END AS zone2, CASE WHEN max(activity_id) % 2 = 0 THEN 140 END AS zone3,
  CASE WHEN max(activity_id) % 2 = 0 THEN 160 END AS zone4, CASE WHEN max(activity_id) % 2 = 0 THEN 175 END AS zone5
FROM (SELECT athlete_id, activity_id, start_s {div} 86400 AS effective_day FROM activities WHERE start_s IS NOT NULL) t
GROUP BY athlete_id, effective_day
"""
PROFILES_SQL = _PROFILES.format(div="//")

_ATHLETES = """
SELECT c_custkey AS athlete_id, CASE c_nationkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS sex,
  CAST(20 + c_custkey % 50 AS DOUBLE) AS age, CAST(45 + c_custkey % 20 AS DOUBLE) AS resting_hr, CAST(60 + c_custkey % 30 AS DOUBLE) AS rider_mass_kg,
  CAST(8 AS DOUBLE) AS bike_mass_kg, CAST(150 + c_custkey % 100 AS DOUBLE) AS ftp, CAST(2100 AS DOUBLE) AS wheel_mm
FROM customer
"""
ATHLETES_SQL = _ATHLETES

_ANALYSES = """
SELECT doc_id AS activity_id, '**Summary** ' || lang || chr(10) || text || chr(10) || '**Advice** rest' AS analysis_text, doc_id % 10 AS analysis_version
FROM documents
"""
ANALYSES_SQL = _ANALYSES


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample of every activity; the one shuffle that later windows by activity reuse."""
    text = _records_select("unix_micros(CAST(ts AS TIMESTAMP))", "DIV", "CAST(get_json_object(props, '$.k') AS INT)")
    return spark.sql(text.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def steady_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_STEADY.format(d="D").replace("FROM records", "FROM {r}"), r=records(spark, sf_dir))


def held_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _HELD.format(d="D", seconds="").rstrip().rstrip(",").replace("FROM records", "FROM {r} LATERAL VIEW explode(sequence(0L, 59L)) seconds AS s")
    return spark.sql(text, r=records(spark, sf_dir).select("activity_id", "record_index", "power"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _ACTIVITIES.format(ts="timestamp_seconds(secs)", text="STRING", days="datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01')")
    return spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def hr_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PROFILES.format(div="DIV").replace("FROM activities", "FROM {a}"), a=activities(spark, sf_dir))


def athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ATHLETES.replace("FROM customer", "FROM {c}"), c=table(spark, sf_dir, "customer"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ANALYSES.replace("FROM documents", "FROM {d}"), d=table(spark, sf_dir, "documents"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array of messages per conversation."""
    text = """SELECT conv_id AS activity_id, to_json(transform(array_sort(collect_list(struct(turn, role, text))), m -> struct(m.role AS role, m.text AS content))) AS chat_json
      FROM {c} GROUP BY conv_id"""
    return spark.sql(text, c=table(spark, sf_dir, "conversations"))


#: Derived tables as CTEs, for SQL that needs them.
CTES = {"records": RECORDS_SQL, "steady": STEADY_SQL, "held": HELD_SQL, "activities": ACTIVITIES_SQL, "profiles": PROFILES_SQL, "athletes": ATHLETES_SQL, "analyses": ANALYSES_SQL}


def with_ctes(*names: str) -> str:
    """``WITH`` clause of derived tables, in the order given."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
