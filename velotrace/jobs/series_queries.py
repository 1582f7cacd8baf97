"""Queries over sample series: cleaning, windows, power and heart-rate measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..functions.shared import bucketed, materialize
from ..operators import clean, heart, power, segments, series, summary
from ..sources import adapters as A
from .registry import query, rounded

R = A.with_ctes("records")
#: Durations that occur in the short test rides.
SHORT = (5, 10, 20, 30, 60)
W_ = "PARTITION BY activity_id ORDER BY record_index"

SPEEDS = f"""{R}, prev AS (
  SELECT *, last_value(CASE WHEN elapsed_s IS NOT NULL AND distance_km IS NOT NULL THEN struct_pack(t := elapsed_s, d := distance_km) END IGNORE NULLS)
    OVER ({W_} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM records
), raw AS (
  SELECT *, CASE WHEN elapsed_s - p.t > 0 AND elapsed_s - p.t <= 30 AND distance_km - p.d >= 0 THEN (distance_km - p.d) / (elapsed_s - p.t) * 3600 END AS r FROM prev
), derived AS (
  SELECT *, coalesce(avg(r) OVER ({W_} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), r) AS derived_kmh FROM raw)"""

HAVERSINE = "2 * 6371 * atan2(sqrt({h}), sqrt(1 - {h}))"


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return HAVERSINE.format(h=h)


FIX = "(position_lat IS NOT NULL AND position_long IS NOT NULL AND NOT (position_lat = 0 AND position_long = 0))"
USE = "PARTITION BY activity_id, use ORDER BY record_index"
GRADED = f"""{R}, g1 AS (
  SELECT *, (elapsed_s IS NOT NULL AND speed_kmh IS NOT NULL AND altitude_m IS NOT NULL AND {FIX}) AS use FROM records
), g2 AS (
  SELECT *, avg(altitude_m) OVER ({USE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS alt, greatest(speed_kmh, 0) / 3.6 AS v FROM g1
), g3 AS (
  SELECT *, CASE WHEN use THEN elapsed_s - lag(elapsed_s) OVER ({USE}) END AS dt, (lag(v) OVER ({USE}) + v) / 2 AS vm,
    (coalesce(distance_km, 0) - coalesce(lag(distance_km) OVER ({USE}), 0)) * 1000 AS driven, alt - lag(alt) OVER ({USE}) AS rise FROM g2
), g4 AS (
  SELECT *, CASE WHEN dt IS NOT NULL THEN vm END AS step_ms, CASE WHEN dt IS NULL THEN NULL WHEN driven > 0 THEN driven ELSE vm * dt END AS step_m FROM g3
), graded AS (
  SELECT *, CASE WHEN dt IS NOT NULL THEN rise / greatest(step_m, 1) END AS grade FROM g4
), gseries AS (
  SELECT *, coalesce(avg(own) OVER ({W_} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), own) AS grade_pct
  FROM (SELECT *, CASE WHEN dt > 0 AND dt <= 5 AND step_m >= 1 THEN grade * 100 END AS own FROM graded) t)"""

#: Stops of the test rides are short, so the least duration is 2 s there.
STOPS = f"""slow AS (SELECT activity_id, record_index, elapsed_s, coalesce(speed_kmh <= 1, false) AS slow FROM records
), slow2 AS (SELECT *, CASE WHEN slow <> lag(slow, 1, false) OVER ({W_}) THEN 1 ELSE 0 END AS new FROM slow
), slow3 AS (SELECT *, sum(new) OVER ({W_}) AS run FROM slow2
), both_stops AS (
  SELECT activity_id, min(record_index) AS start_index, max(record_index) AS end_index, arg_min(elapsed_s, record_index) AS start_s, arg_max(elapsed_s, record_index) AS end_s
  FROM slow3 WHERE slow GROUP BY activity_id, run HAVING arg_max(elapsed_s, record_index) - arg_min(elapsed_s, record_index) >= 2
  UNION ALL
  SELECT activity_id, i0, record_index, t0, elapsed_s FROM (SELECT activity_id, record_index, elapsed_s, lag(record_index) OVER ({W_}) AS i0, lag(elapsed_s) OVER ({W_}) AS t0 FROM records) t
  WHERE elapsed_s - t0 >= 10
), islands AS (
  SELECT *, sum(new) OVER (PARTITION BY activity_id ORDER BY start_index, end_index ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_index <= max(end_index) OVER (PARTITION BY activity_id ORDER BY start_index, end_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM both_stops) t
), stops AS (
  SELECT activity_id, min(start_index) AS start_index, max(end_index) AS end_index, arg_min(start_s, start_index) AS start_s, arg_max(end_s, end_index) AS end_s
  FROM islands GROUP BY activity_id, island)"""

RUNS = f"""{R}, valid AS (SELECT * FROM records WHERE power >= 0
), marked AS (SELECT *, CASE WHEN elapsed_ms - lag(elapsed_ms) OVER (PARTITION BY activity_id ORDER BY elapsed_ms, record_index) > 5000 THEN 1 ELSE 0 END AS new FROM valid
), runs AS (SELECT *, sum(new) OVER (PARTITION BY activity_id ORDER BY elapsed_ms, record_index ROWS UNBOUNDED PRECEDING) AS run FROM marked)"""


def mmp_sql(durations: tuple[int, ...] = SHORT) -> str:
    parts = [
        f"""SELECT activity_id, {d} AS duration_s, coalesce(max(CASE WHEN span >= {d * 1000} THEN m END), 0) AS power FROM (
      SELECT activity_id, avg(power) OVER w AS m, max(elapsed_ms) OVER w - elapsed_ms AS span FROM runs
      WINDOW w AS (PARTITION BY activity_id, run ORDER BY elapsed_ms RANGE BETWEEN CURRENT ROW AND {d * 1000} FOLLOWING)) t GROUP BY activity_id"""
        for d in durations
    ]
    return f"{RUNS}, mmp AS ({' UNION ALL '.join(parts)})"


@query(f"""{R}, rolled AS (
  SELECT activity_id, avg(power) OVER (PARTITION BY activity_id ORDER BY elapsed_ms RANGE BETWEEN 29999 PRECEDING AND CURRENT ROW) AS m FROM records WHERE power >= 0
), np AS (SELECT activity_id, pow(avg(pow(m, 4)), 0.25) AS np FROM rolled GROUP BY activity_id
), dur AS (SELECT activity_id, max(elapsed_s) AS d FROM records GROUP BY activity_id)
SELECT activity_id, round(np, 6) AS np, round(np / 250, 6) AS intensity, round(CASE WHEN d > 0 AND np > 0 THEN d * np * (np / 250) / (250 * 3600) * 100 ELSE 0 END, 6) AS tss FROM np JOIN dur USING (activity_id)""")
def a2_normalized_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized power, intensity and training stress of every activity (flagship)."""
    records = A.records(spark, sf_dir)
    rows = power.normalized_power(records).join(summary.estimate_duration(records), "activity_id").withColumn("ftp", F.lit(250.0))
    rows = rows.withColumn("intensity", S.intensity_factor("np", "ftp")).withColumn("tss", S.stress_score("duration_s", "np", "intensity", "ftp"))
    return rounded(rows.select("activity_id", "np", "intensity", "tss"), "np", "intensity", "tss")


@query(f"{SPEEDS} SELECT activity_id, record_index, round(coalesce(avg(speed_kmh) OVER ({W_} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), speed_kmh), 6) AS smooth_kmh, round(CASE WHEN speed_kmh > 0 THEN speed_kmh WHEN speed_kmh IS NULL THEN derived_kmh WHEN derived_kmh > 1 THEN derived_kmh ELSE speed_kmh END, 6) AS speed_kmh FROM derived")
def p4_p6_w1_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed and normalised speeds."""
    records = A.records(spark, sf_dir).withColumn("smooth_kmh", clean.smooth("speed_kmh", 5))
    return rounded(clean.normalize_speeds(records).select("activity_id", "record_index", "smooth_kmh", "speed_kmh"), "smooth_kmh", "speed_kmh")


@query(f"""{R} SELECT activity_id, record_index, CASE WHEN speed_kmh > 0 THEN speed_kmh WHEN cadence > 50 THEN cadence - 50 ELSE speed_kmh END AS speed_kmh,
  CASE WHEN record_index % 3 = 0 THEN temperature ELSE altitude_m END AS altitude_m FROM records""")
def p4_enhanced_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enhanced channels (made from cadence and temperature) where the plain ones are zero or missing."""
    records = A.records(spark, sf_dir).withColumn("altitude_m", F.when(F.col("record_index") % 3 != 0, F.col("altitude_m")))
    filled = clean.enhanced_fallback(records.withColumn("enhanced_speed", F.col("cadence") - 50), altitude="temperature")
    return filled.select("activity_id", "record_index", "speed_kmh", "altitude_m")


@query(f"""{R}, fixed AS (SELECT *, CASE WHEN {FIX} THEN struct_pack(t := elapsed_s, la := position_lat, lo := position_long) END AS f FROM records
), prev AS (SELECT *, last_value(f IGNORE NULLS) OVER ({W_} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM fixed
), raw AS (SELECT *, CASE WHEN elapsed_s - p.t > 0 AND elapsed_s - p.t <= 30 AND f IS NOT NULL THEN {_haversine('p.la', 'p.lo', 'f.la', 'f.lo')} / (elapsed_s - p.t) * 3600 END AS r FROM prev)
SELECT activity_id, record_index, round(coalesce(avg(r) OVER ({W_} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), r), 6) AS gps_kmh FROM raw""")
def w4_gps_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.gps_speed(A.records(spark, sf_dir)).select("activity_id", "record_index", "gps_kmh"), "gps_kmh")


@query(f"{GRADED} SELECT activity_id, record_index, round(grade, 6) AS grade, round(dt, 6) AS dt, round(step_m, 6) AS step_m, round(grade_pct, 6) AS grade_pct FROM gseries")
def g1_g2_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = series.grade_series_pct(series.compute_grade(A.records(spark, sf_dir)))
    return rounded(graded.select("activity_id", "record_index", "grade", "dt", "step_m", "grade_pct"), "grade", "dt", "step_m", "grade_pct")


@query(f"""{GRADED} SELECT activity_id, record_index, CASE WHEN {FIX} THEN position_lat END AS position_lat, nullif(cadence, 0) AS cadence, nullif(temperature, 0) AS temperature,
  CASE WHEN dt > 0 AND dt <= 5 AND step_m >= 1 THEN floor(grade * 100 * 100 + 0.5) / 100 END AS grade_pct FROM graded""")
def p7_p8_record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.record_rows(series.compute_grade(A.records(spark, sf_dir)))
    return rows.select("activity_id", "record_index", "position_lat", "cadence", "temperature", "grade_pct")


EST = f"""{GRADED}, est AS (
  SELECT *, CASE WHEN dt > 0 AND dt <= 5 AND step_ms >= 0.5 AND abs(grade) <= 0.18 THEN least(1200, greatest(0, 85 * 9.80665 * sin(atan(grade)) * step_ms
    + 85 * 9.80665 * 0.004 * cos(atan(grade)) * step_ms + 0.5 * 1.225 * 0.25 * step_ms * step_ms * step_ms) / 0.97) END AS e FROM graded)"""


@query(f"""{EST}
SELECT activity_id, record_index, round(e, 6) AS estimated, CASE WHEN activity_id % 2 = 0 AND activity_id IN (SELECT activity_id FROM records WHERE power >= 0) THEN 'measured' WHEN count(e) OVER (PARTITION BY activity_id) > 0 THEN 'estimated' ELSE 'unavailable' END AS power_source
FROM est""")
def g3_g4_estimated_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power from motion; activities of odd id are taken as having no power meter."""
    records = A.records(spark, sf_dir).withColumn("power", F.when(F.col("activity_id") % 2 == 0, F.col("power")))
    filled = series.add_estimated_power(series.compute_grade(records).withColumn("estimated", series.estimate_power(F.lit(75.0), F.lit(10.0))), F.lit(75.0), F.lit(10.0))
    return rounded(filled.select("activity_id", "record_index", "estimated", "power_source"), "estimated")


@query(f"""{R}, d AS (SELECT *, lead(coalesce(elapsed_s, 0)) OVER ({W_}) - coalesce(elapsed_s, 0) AS dt FROM records
), m AS (SELECT activity_id, coalesce(median(dt) FILTER (WHERE dt > 0 AND dt <= 30), 1) AS med FROM d GROUP BY activity_id)
SELECT activity_id, record_index, round(CASE WHEN dt IS NULL THEN med WHEN dt > 0 AND dt <= 30 THEN dt ELSE 1 END, 6) AS seconds FROM d JOIN m USING (activity_id)""")
def w5_record_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.with_record_duration(A.records(spark, sf_dir)).select("activity_id", "record_index", "seconds"), "seconds")


@query(f"{RUNS} SELECT activity_id, run, count(*) AS n, min(elapsed_ms) AS first_ms, max(elapsed_ms) AS last_ms FROM runs GROUP BY activity_id, run")
def w6_effort_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = series.effort_runs(A.records(spark, sf_dir))
    return runs.groupBy("activity_id", "run").agg(F.count("*").alias("n"), F.min("elapsed_ms").alias("first_ms"), F.max("elapsed_ms").alias("last_ms"))


@query(f"{R}, {STOPS} SELECT activity_id, start_index, end_index, round(end_s - start_s, 6) AS duration_s FROM stops")
def w8_w10_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = series.detect_stops(A.records(spark, sf_dir), least=2.0)
    return rounded(stops.select("activity_id", "start_index", "end_index", "duration_s"), "duration_s")


TERRAIN = f"""{GRADED}, {STOPS}, marked AS (
  SELECT g.*, s.start_index IS NOT NULL AS stopped FROM gseries g LEFT JOIN stops s ON g.activity_id = s.activity_id AND g.record_index BETWEEN s.start_index AND s.end_index
), banded AS (SELECT *, CASE WHEN grade_pct IS NULL OR stopped THEN NULL WHEN grade_pct > 3 THEN 'C' WHEN grade_pct < -3 THEN 'D' WHEN grade_pct >= 2 THEN 'U' WHEN grade_pct <= -2 THEN 'L' ELSE 'F' END AS b FROM marked
), lasts AS (SELECT *, last_value(CASE WHEN b <> 'U' THEN b END IGNORE NULLS) OVER w AS u, last_value(CASE WHEN b <> 'L' THEN b END IGNORE NULLS) OVER w AS l FROM banded
  WINDOW w AS ({W_} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), state AS (SELECT *, CASE b WHEN 'C' THEN 'climb' WHEN 'D' THEN 'descent' WHEN 'F' THEN 'flat' WHEN 'U' THEN CASE WHEN u = 'C' THEN 'climb' ELSE 'flat' END WHEN 'L' THEN CASE WHEN l = 'D' THEN 'descent' ELSE 'flat' END END AS s FROM lasts
), terrain AS (SELECT *, CASE WHEN stopped THEN 'stopped' ELSE coalesce(last_value(s IGNORE NULLS) OVER ({W_} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'flat') END AS terrain FROM state
), truns AS (SELECT *, sum(new) OVER ({W_} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN terrain = lag(terrain) OVER ({W_}) THEN 0 ELSE 1 END AS new FROM terrain) t)"""


@query(f"{TERRAIN} SELECT activity_id, any_value(terrain) AS terrain, min(record_index) AS start_index, max(record_index) AS end_index FROM truns GROUP BY activity_id, run")
def w11_w12_terrain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = A.records(spark, sf_dir)
    marked = series.mark_intervals(series.grade_series_pct(series.compute_grade(records)), series.detect_stops(records, least=2.0))
    return series.terrain_runs(series.terrain_state(marked)).select("activity_id", "terrain", "start_index", "end_index")


@query(f"{R}, {STOPS} SELECT r.activity_id, r.record_index, s.start_index IS NOT NULL AS stopped FROM records r LEFT JOIN stops s ON r.activity_id = s.activity_id AND r.record_index BETWEEN s.start_index AND s.end_index")
def j8_records_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = A.records(spark, sf_dir)
    return series.mark_intervals(records, series.detect_stops(records, least=2.0)).select("activity_id", "record_index", "stopped")


@query(f"{mmp_sql()} SELECT activity_id, duration_s, round(power, 6) AS power FROM mmp")
def a5_mmp_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power.mmp_curve(A.records(spark, sf_dir), SHORT), "power")


@query(f"{mmp_sql(SHORT + power.DURATIONS[1:])} SELECT activity_id, duration_s, round(power, 6) AS power FROM mmp")
def a5_mmp_curve_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same curve with the operator's own durations up to an hour."""
    return rounded(power.mmp_curve(A.records(spark, sf_dir), SHORT + power.DURATIONS[1:]), "power")


@query(f"""{mmp_sql()}, best AS (SELECT activity_id % 10 AS team, duration_s, max(power) AS power FROM mmp GROUP BY ALL
), fit AS (SELECT team, count(*) FILTER (WHERE power > 0) AS n, regr_slope(power, 1.0 / duration_s) FILTER (WHERE power > 0) AS s, regr_intercept(power, 1.0 / duration_s) FILTER (WHERE power > 0) AS i,
  CASE WHEN var_pop(power) FILTER (WHERE power > 0) = 0 THEN 0 ELSE regr_r2(power, 1.0 / duration_s) FILTER (WHERE power > 0) END AS r FROM best GROUP BY team)
SELECT team, round(CASE WHEN ok THEN i END, 6) AS cp, round(CASE WHEN ok THEN s END, 6) AS w_prime, round(CASE WHEN ok THEN r END, 6) AS r_squared, CASE WHEN ok AND i * 0.97 BETWEEN 80 AND 500 THEN floor(i * 0.97 + 0.5) ELSE 0 END AS ftp
FROM (SELECT *, coalesce(n >= 3 AND i > 0 AND s >= 0 AND r >= 0.85, false) AS ok FROM fit) t""")
def a6_a8_a9_ftp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best curve, critical power and chosen threshold power of groups of athletes."""
    curve = power.mmp_curve(A.records(spark, sf_dir), SHORT).withColumn("team", F.col("activity_id") % 10)
    fit = power.ftp_candidates(power.historical_mmp(curve, "team"), "team").withColumn("ftp", power.select_ftp())
    return rounded(fit.select("team", "cp", "w_prime", "r_squared", "ftp"), "cp", "w_prime", "r_squared")


LONG = mmp_sql(power.DURATIONS).replace(R, A.with_ctes("records", "held"), 1).replace("FROM records WHERE power >= 0", "FROM held WHERE power >= 0")


@query(f"""{LONG}, best AS (SELECT activity_id % 40 AS athlete_id, duration_s, max(power) AS power FROM mmp GROUP BY ALL
), fit AS (SELECT athlete_id, count(*) FILTER (WHERE power > 0) AS n, regr_slope(power, 1.0 / duration_s) FILTER (WHERE power > 0) AS s, regr_intercept(power, 1.0 / duration_s) FILTER (WHERE power > 0) AS i,
    CASE WHEN var_pop(power) FILTER (WHERE power > 0) = 0 THEN 0 ELSE regr_r2(power, 1.0 / duration_s) FILTER (WHERE power > 0) END AS r,
    max(power) FILTER (WHERE duration_s = 3600 AND power > 0) AS h, max(power) FILTER (WHERE duration_s = 3300 AND power > 0) AS h55, max(power) FILTER (WHERE duration_s = 3000 AND power > 0) AS h50, max(power) FILTER (WHERE duration_s = 1200 AND power > 0) * 0.95 AS p20
  FROM best GROUP BY athlete_id
), cand AS (SELECT athlete_id, CASE WHEN n >= 3 AND i > 0 AND s >= 0 AND r >= 0.85 THEN i * 0.97 END AS cp_derived, h AS mmp_60min, CASE WHEN h IS NULL THEN coalesce(h55, h50) END AS mmp_close_to_60min, p20 FROM fit)
SELECT athlete_id, round(cp_derived, 6) AS cp_derived, round(mmp_60min, 6) AS mmp_60min, round(mmp_close_to_60min, 6) AS mmp_close_to_60min, round(p20, 6) AS p20, coalesce({', '.join(f"CASE WHEN {c} BETWEEN 80 AND 500 THEN floor({c} + 0.5) END" for c in ('cp_derived', 'mmp_60min', 'mmp_close_to_60min', 'p20'))}, 0) AS ftp FROM cand""")
def a5_a9_hour_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of the operator's own durations over rides of an hour and more, and all candidates for the threshold power they give."""
    curves = power.mmp_curve(A.held_records(spark, sf_dir)).withColumn("athlete_id", F.col("activity_id") % 40)
    fit = power.ftp_candidates(power.historical_mmp(curves, "athlete_id"), "athlete_id").withColumn("ftp", power.select_ftp())
    names = ("cp_derived", "mmp_60min", "mmp_close_to_60min", "p20")
    return rounded(fit.select("athlete_id", *names, "ftp"), *names)


@query(f"""{RUNS}, best AS (SELECT activity_id, max(CASE WHEN span >= 19000 THEN m END) AS m FROM (SELECT activity_id, avg(power) OVER w AS m, max(elapsed_ms) OVER w - elapsed_ms AS span FROM runs
  WINDOW w AS (PARTITION BY activity_id, run ORDER BY elapsed_ms RANGE BETWEEN CURRENT ROW AND 20000 FOLLOWING)) t GROUP BY activity_id)
SELECT activity_id, CASE WHEN floor(m * 0.95 + 0.5) BETWEEN 80 AND 500 THEN floor(m * 0.95 + 0.5) ELSE 0 END AS ftp FROM best""")
def a7_auto_ftp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power.auto_ftp(A.records(spark, sf_dir), seconds=20, span=19)


XP = f"""{R}, v AS (SELECT activity_id, row_number() OVER ({W_}) AS i, elapsed_s AS t, power AS p FROM records WHERE power >= 0
), x AS (
  SELECT activity_id, i, t, p AS f FROM v WHERE i = 1
  UNION ALL
  SELECT v.activity_id, v.i, v.t, x.f + (1 - exp(-(CASE WHEN v.t - x.t > 0 THEN least(v.t - x.t, 30) ELSE 1 END) / 25)) * (v.p - x.f) FROM x JOIN v ON v.activity_id = x.activity_id AND v.i = x.i + 1)"""


XPOWER = f"{XP} SELECT activity_id, pow(avg(pow(f, 4)), 0.25) AS xpower FROM x GROUP BY activity_id"


@query(f"SELECT activity_id, round(xpower, 6) AS xpower FROM ({XPOWER})")
def w7_a3_xpower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power.x_power(A.records(spark, sf_dir)), "xpower")


ELEVATION = f"""{R}, a AS (SELECT activity_id, row_number() OVER ({W_}) AS i, avg(altitude_m) OVER ({W_} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM records WHERE altitude_m IS NOT NULL
), e AS (
  SELECT activity_id, i, a AS ref, 0::DOUBLE AS up, 0::DOUBLE AS down FROM a WHERE i = 1
  UNION ALL
  SELECT a.activity_id, a.i, CASE WHEN abs(a.a - e.ref) >= 3 THEN a.a ELSE e.ref END, e.up + CASE WHEN a.a - e.ref >= 3 THEN a.a - e.ref ELSE 0 END, e.down + CASE WHEN e.ref - a.a >= 3 THEN e.ref - a.a ELSE 0 END
  FROM e JOIN a ON a.activity_id = e.activity_id AND a.i = e.i + 1)
SELECT activity_id, max(up) AS gain_m, max(down) AS loss_m FROM e GROUP BY activity_id"""


@query(f"SELECT activity_id, round(gain_m, 6) AS gain_m, round(loss_m, 6) AS loss_m FROM ({ELEVATION})")
def w19_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power.elevation_gain_loss(A.records(spark, sf_dir)), "gain_m", "loss_m")


DESPIKED = f"""{R}, v AS (SELECT activity_id, row_number() OVER ({W_}) AS i, speed_kmh AS c, lead(speed_kmh) OVER ({W_}) AS n FROM records WHERE speed_kmh IS NOT NULL
), d AS (
  SELECT activity_id, i, c AS f FROM v WHERE i = 1
  UNION ALL
  SELECT v.activity_id, v.i, CASE WHEN v.n IS NOT NULL AND abs(v.n - d.f) / greatest(1, abs((d.f + v.n) / 2)) < 0.5 AND abs(v.c - (d.f + v.n) / 2) > 12
    AND abs(v.c - (d.f + v.n) / 2) / greatest(1, abs((d.f + v.n) / 2)) > 0.5 THEN (d.f + v.n) / 2 ELSE v.c END FROM d JOIN v ON v.activity_id = d.activity_id AND v.i = d.i + 1)
SELECT activity_id, max(f) AS max_speed FROM d GROUP BY activity_id"""


@query(f"SELECT activity_id, round(max_speed, 6) AS max_speed FROM ({DESPIKED})")
def w3_despiked_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.max_despiked_speed(A.records(spark, sf_dir)), "max_speed")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top rates and thresholds of the test activities: own thresholds for even ids."""
    ids = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("activity_id")).distinct()
    own = F.when(F.col("activity_id") % 2 == 0, F.array(F.lit(120.0), F.lit(140.0), F.lit(160.0), F.lit(175.0)))
    return ids.withColumn("top_hr", F.lit(190.0)).withColumn("thresholds", S.zone_thresholds("top_hr", F.coalesce(own, F.array().cast("array<double>"))))


ZONE = "(1 + CAST({h} >= CASE WHEN activity_id % 2 = 0 THEN 120 ELSE 190 * 0.6 END AS INT) + CAST({h} >= CASE WHEN activity_id % 2 = 0 THEN 140 ELSE 190 * 0.7 END AS INT) + CAST({h} >= CASE WHEN activity_id % 2 = 0 THEN 160 ELSE 190 * 0.8 END AS INT) + CAST({h} >= CASE WHEN activity_id % 2 = 0 THEN 175 ELSE 190 * 0.9 END AS INT))"


ZONES = f"""{R}, d AS (SELECT *, lead(coalesce(elapsed_s, 0)) OVER ({W_}) - coalesce(elapsed_s, 0) AS dt FROM records
), m AS (SELECT activity_id, coalesce(median(dt) FILTER (WHERE dt > 0 AND dt <= 30), 1) AS med FROM d GROUP BY activity_id
), t AS (SELECT activity_id, heart_rate, CASE WHEN dt IS NULL THEN med WHEN dt > 0 AND dt <= 30 THEN dt ELSE 1 END AS s FROM d JOIN m USING (activity_id)
), z AS (SELECT activity_id, {ZONE.format(h='heart_rate')} AS zone, sum(s) AS s FROM t WHERE heart_rate >= 95 GROUP BY ALL
), f AS (SELECT a.activity_id, q.zone, coalesce(z.s, 0) AS s FROM (SELECT DISTINCT activity_id FROM records) a CROSS JOIN range(1, 6) q(zone) LEFT JOIN z ON z.activity_id = a.activity_id AND z.zone = q.zone)"""


@query(f"""{ZONES}
SELECT activity_id, CAST(zone AS INT) AS zone, round(s, 6) AS seconds, round(CASE WHEN sum(s) OVER (PARTITION BY activity_id) > 0 THEN s / sum(s) OVER (PARTITION BY activity_id) * 100 ELSE 0 END, 6) AS percent FROM f""")
def h13_h14_a10_zone_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(heart.hr_zone_time(A.records(spark, sf_dir), _limits(spark, sf_dir)), "seconds", "percent")


@query(f"""{R}, p AS (SELECT activity_id, record_index, (heart_rate + lag(heart_rate) OVER ({W_})) / 2 AS h FROM records WHERE heart_rate > 0)
SELECT activity_id, record_index, {ZONE.format(h='h')} AS zone FROM p WHERE h IS NOT NULL""")
def w20_point_pair_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heart.point_pair_zone(A.records(spark, sf_dir), _limits(spark, sf_dir))


@query(f"""{R}, long AS (UNPIVOT (SELECT activity_id, speed_kmh, heart_rate, altitude_m, power, cadence FROM records) ON speed_kmh, heart_rate, altitude_m, power, cadence INTO NAME channel VALUE value)
SELECT activity_id, channel, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM long GROUP BY ALL""")
def a11_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.channel_stats(A.records(spark, sf_dir)), "mean", "median", "p95")


@query(f"""{R}, long AS (UNPIVOT (SELECT activity_id % 12 AS athlete_id, speed_kmh, heart_rate, altitude_m, power, cadence FROM records) ON speed_kmh, heart_rate, altitude_m, power, cadence INTO NAME channel VALUE value)
SELECT athlete_id, channel, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, true AS median_holds, true AS p95_holds FROM long GROUP BY ALL""")
def a11_merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of single rides merged by athlete; their quantiles are held against the ranks they have among all values (5 % at most)."""
    records = A.records(spark, sf_dir)
    stats = materialize(summary.merged_channel_stats(summary.channel_sketches(records).withColumn("athlete_id", F.col("activity_id") % 12), "athlete_id"), "merged-stats")
    values = summary.unpivot(records).where("value IS NOT NULL").select((F.col("activity_id") % 12).alias("athlete_id"), "channel", "value")
    ranked = values.join(stats.select("athlete_id", "channel", "median", "p95"), ["athlete_id", "channel"]).groupBy("athlete_id", "channel")
    holds = {"median": 0.5, "p95": 0.95}
    shares = ranked.agg(*[F.avg((F.col("value") < F.col(c)).cast("int")).alias(f"{c}_below") for c in holds], *[F.avg((F.col("value") <= F.col(c)).cast("int")).alias(f"{c}_upto") for c in holds])
    told = shares.select("athlete_id", "channel", *[((F.col(f"{c}_below") <= q + 0.05) & (F.col(f"{c}_upto") >= q - 0.05)).alias(f"{c}_holds") for c, q in holds.items()])
    return rounded(stats.drop("median", "p95").join(told, ["athlete_id", "channel"]), "mean")


@query(f"""{R}, f AS (SELECT activity_id, record_index, position_lat, position_long, speed_kmh, heart_rate, lag(position_lat) OVER ({W_}) AS la, lag(position_long) OVER ({W_}) AS lo FROM records WHERE {FIX})
SELECT activity_id, count(*) AS n_points, round(coalesce(sum({_haversine('la', 'lo', 'position_lat', 'position_long')}), 0), 6) AS path_km, min(position_lat) AS south, max(position_lat) AS north, min(position_long) AS west, max(position_long) AS east, {', '.join(f"count({c}) AS {n}_n, coalesce(min({c}), 0) AS {n}_low, coalesce(max({c}), 0) AS {n}_high, round(coalesce(avg({c}), 0), 6) AS {n}_mean, round(coalesce(quantile_cont({c}, 0.5), 0), 6) AS {n}_median, round(coalesce(quantile_cont({c}, 0.95), 0), 6) AS {n}_p95" for n, c in (('speed', 'speed_kmh'), ('hr', 'heart_rate')))} FROM f GROUP BY activity_id""")
def a12_h1_route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, bounds, speeds and heart rates of every route."""
    return rounded(summary.route_stats(A.records(spark, sf_dir)), "path_km", *[f"{n}_{m}" for n in ("speed", "hr") for m in ("mean", "median", "p95")])


@query(f"""{EST}, own AS (SELECT *, CASE WHEN activity_id % 2 = 0 THEN power END AS p FROM est)
SELECT activity_id, count(*) AS n_records, count(*) FILTER (WHERE p >= 0) AS n_power, count(*) FILTER (WHERE p >= 0 AND elapsed_s IS NOT NULL) AS n_timed,
  CASE WHEN count(*) FILTER (WHERE p >= 0) > 0 THEN 'measured' WHEN count(e) > 0 THEN 'estimated' ELSE 'unavailable' END AS power_source, round(floor(avg(temperature) * 10 + 0.5) / 10, 6) AS avg_temperature, max(elapsed_s) AS duration_s FROM own GROUP BY activity_id""")
def a19_a21_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by power; activities of odd id are taken as having no power meter."""
    records = A.records(spark, sf_dir).withColumn("power", F.when(F.col("activity_id") % 2 == 0, F.col("power")))
    guessed = series.compute_grade(records).withColumn("estimated", series.estimate_power(F.lit(75.0), F.lit(10.0)))
    rows = power.power_coverage(guessed).join(summary.average_temperature(records), "activity_id").join(summary.estimate_duration(records), "activity_id")
    return rounded(rows, "avg_temperature")


@query(f"""{R}, n AS (SELECT activity_id, record_index, row_number() OVER ({W_}) - 1 AS i, count(*) OVER (PARTITION BY activity_id) AS n FROM records
), k AS (SELECT DISTINCT activity_id, CAST(floor(k.k * (n / 40.0::DOUBLE)) AS BIGINT) AS i FROM (SELECT DISTINCT activity_id, n FROM n) t, range(0, 40) k(k))
SELECT n.activity_id, n.record_index FROM n LEFT JOIN k ON k.activity_id = n.activity_id AND k.i = n.i WHERE n.n <= 40 OR k.i IS NOT NULL""")
def t2_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.downsample(A.records(spark, sf_dir).select("activity_id", "record_index"), 40)


@query(f"{R} SELECT activity_id, record_index, distance_km AS x, power AS y FROM records WHERE record_index % 5 = 0 AND distance_km IS NOT NULL AND power IS NOT NULL")
def p12_p13_stride_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.project_xy(clean.stride_filter(A.records(spark, sf_dir), 5), "distance_km", "power")


@query(f"""{R}, long AS (UNPIVOT (SELECT activity_id, record_index, distance_km, speed_kmh, heart_rate, altitude_m FROM records) ON speed_kmh, heart_rate, altitude_m INTO NAME channel VALUE value
), v AS (SELECT *, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi FROM long WINDOW w AS (PARTITION BY activity_id, channel))
SELECT activity_id, channel, record_index, distance_km, value FROM v WHERE n >= 2 AND lo <> hi""")
def t5_overlay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of the channels that vary, however many a ride has; the budget of a chart is left to its display."""
    return summary.overlay_metrics(A.records(spark, sf_dir), most=None)


@query(f"""{GRADED}, v AS (SELECT *, grade * 100 AS value, count(grade) OVER w AS n, min(grade) OVER w AS lo, max(grade) OVER w AS hi FROM graded WHERE grade IS NOT NULL AND distance_km IS NOT NULL WINDOW w AS (PARTITION BY activity_id))
SELECT activity_id, 'grade_pct' AS channel, record_index, distance_km, round(value, 6) AS value FROM v WHERE n >= 2 AND lo <> hi""")
def t5_overlay_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade channel of the overlays, computed as no record stores one."""
    graded = summary.overlay_grade(series.compute_grade(A.records(spark, sf_dir)))
    return rounded(summary.overlay_metrics(graded, most=None, channels=("grade_pct",)), "value")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("activity_id")).distinct()
    sport = F.element_at(F.array(F.lit("cycling"), F.lit("running"), F.lit("rowing")), F.pmod("activity_id", F.lit(3)).cast("int") + 1)
    return ids.select("activity_id", sport.alias("sport"), F.lit("measured").alias("power_source"), F.lit(200.0).alias("ftp"), F.lit(50.0).alias("rest_hr"), F.lit(190.0).alias("top_hr"), F.lit("male").alias("sex"))


#: Run by run: ``k`` final runs so far, the last one's kind and ends, and the begin (``ci, cs``) that a short run gave to the next.
MACROS = f"""{TERRAIN}, runs13 AS (
  SELECT *, row_number() OVER w AS n, lead(terrain) OVER w AS nx, lead(e) OVER w - lead(s) OVER w AS ahead FROM (
    SELECT activity_id, any_value(terrain) AS terrain, min(record_index) AS i, max(record_index) AS j, arg_min(elapsed_s, record_index) AS s, arg_max(elapsed_s, record_index) AS e FROM truns GROUP BY activity_id, run) t
  WINDOW w AS (PARTITION BY activity_id ORDER BY i)
), scan13 AS (
  SELECT DISTINCT activity_id, 0::BIGINT AS n, 0 AS k, NULL::VARCHAR AS top, NULL::BIGINT AS ti, NULL::BIGINT AS tj, NULL::DOUBLE AS ts, NULL::DOUBLE AS te, NULL::BIGINT AS ci, NULL::DOUBLE AS cs FROM runs13
  UNION ALL
  SELECT activity_id, n, CASE WHEN into_top OR goes_on THEN k ELSE k + 1 END, CASE WHEN into_top OR goes_on THEN top ELSE terrain END, CASE WHEN into_top OR goes_on THEN ti ELSE xi END,
    CASE WHEN goes_on THEN tj ELSE j END, CASE WHEN into_top OR goes_on THEN ts ELSE xs END, CASE WHEN goes_on THEN te WHEN into_top THEN coalesce(e, te) ELSE e END,
    CASE WHEN goes_on THEN xi END, CASE WHEN goes_on THEN xs END
  FROM (SELECT *, (k > 0 AND top = terrain) OR (short AND k > 0 AND NOT after) AS into_top, NOT (k > 0 AND coalesce(top = terrain, false)) AND short AND after AS goes_on FROM (
    SELECT a.k, a.top, a.ti, a.tj, a.ts, a.te, r.*, coalesce(a.ci, r.i) AS xi, coalesce(a.cs, r.s) AS xs, r.terrain <> 'stopped' AND NOT coalesce(r.e - coalesce(a.cs, r.s) >= 20, false) AS short,
      r.nx IS NOT NULL AND NOT (a.k > 0 AND (r.nx = 'stopped' OR (a.top <> 'stopped' AND NOT coalesce(r.ahead > a.te - a.ts, false)))) AS after
    FROM scan13 a JOIN runs13 r ON r.activity_id = a.activity_id AND r.n = a.n + 1) t) t
), macros AS (SELECT activity_id, arg_max(top, n) AS terrain, arg_max(ti, n) AS start_index, arg_max(tj, n) AS end_index FROM scan13 WHERE k > 0 GROUP BY activity_id, k)"""


@query(f"{MACROS} SELECT * FROM macros")
def w13_macro_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.macro_segments(A.records(spark, sf_dir), min_seconds=20.0, least=2.0)


_CHAIN = """{n}_next AS (SELECT a.*, (SELECT min(struct_pack(t := b.elapsed_ms, j := b.record_index)) FROM {n} b WHERE {same} AND b.elapsed_ms >= a.elapsed_ms + {pause}).j AS j FROM {n} a
), {n}_links AS (SELECT {keys}, min(struct_pack(t := elapsed_ms, i := record_index)).i AS i FROM {n} GROUP BY {keys}
  UNION ALL SELECT {l_keys}, x.j FROM {n}_links l JOIN {n}_next x ON {l_same} AND x.record_index = l.i AND x.j IS NOT NULL)"""


def _chain(n: str, pause: int, *keys: str) -> str:
    """The begins ``i`` of a greedy chain over table ``n`` (of ``keys, record_index, elapsed_ms``), link by link, as table ``{n}_links``."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return _CHAIN.format(n=n, pause=pause, keys=", ".join(keys), l_keys=", ".join(f"l.{k}" for k in keys), same=same("a", "b"), l_same=same("l", "x"))


_HOP = _haversine("la", "lo", "position_lat", "position_long")


def trusted_sql(source: str, pause_ms: int, km: float) -> str:
    """CTEs up to ``trusted``: windows of ``source`` whose speeds can be trusted."""
    return f"""fixed AS (SELECT *, {FIX} AS fix, CASE WHEN {FIX} THEN struct_pack(t := elapsed_s, la := position_lat, lo := position_long) END AS f FROM {source}
), prev AS (SELECT *, last_value(f IGNORE NULLS) OVER ({W_} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM fixed
), raw AS (SELECT *, CASE WHEN elapsed_s - p.t > 0 AND elapsed_s - p.t <= 30 AND f IS NOT NULL THEN {_haversine('p.la', 'p.lo', 'f.la', 'f.lo')} / (elapsed_s - p.t) * 3600 END AS r FROM prev
), gps AS (SELECT *, coalesce(avg(r) OVER ({W_} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), r) AS gps_kmh FROM raw
), fixes AS (SELECT activity_id, record_index, elapsed_ms FROM gps WHERE fix), {_chain("fixes", pause_ms, "activity_id")}
, placed AS (SELECT g.*, last_value(l.i IGNORE NULLS) OVER (PARTITION BY g.activity_id ORDER BY record_index ROWS UNBOUNDED PRECEDING) AS win FROM gps g LEFT JOIN fixes_links l ON l.activity_id = g.activity_id AND l.i = g.record_index
), steps AS (SELECT *, lag(position_lat) OVER o AS la, lag(position_long) OVER o AS lo, lag(gps_kmh) OVER o AS gv, elapsed_s - lag(elapsed_s) OVER o AS dt FROM placed WHERE win IS NOT NULL
  WINDOW o AS (PARTITION BY activity_id, win, fix ORDER BY record_index)
), judged AS (
  SELECT activity_id, win, max(record_index) AS last, count(*) AS n, count(*) FILTER (WHERE fix) AS f, sum({_HOP}) FILTER (WHERE fix) AS path,
    coalesce(bool_or(fix AND dt > 0 AND abs(gps_kmh - gv) / 3.6 > 4 * dt), false) AS jerk, count(gps_kmh - speed_kmh) FILTER (WHERE fix) AS d,
    median(abs(gps_kmh - speed_kmh) / greatest(speed_kmh, 1)) FILTER (WHERE fix) AS m, arg_max(distance_km, record_index) - arg_min(distance_km, record_index) AS wheel,
    arg_min(position_lat, record_index) FILTER (WHERE fix) AS la, arg_min(position_long, record_index) FILTER (WHERE fix) AS lo,
    arg_max(position_lat, record_index) FILTER (WHERE fix) AS position_lat, arg_max(position_long, record_index) FILTER (WHERE fix) AS position_long
  FROM steps GROUP BY activity_id, win
), trusted AS (SELECT activity_id, win AS start_index, last AS end_index, path, wheel FROM judged
  WHERE f >= 3 AND f >= n * 0.9 AND NOT jerk AND path >= {km} AND {_HOP} / path >= 0.9 AND d >= f * 0.9 AND m * 100 <= 5)"""


TRUSTED = f"{A.with_ctes('records', 'steady')}, {trusted_sql('steady', 20001, 0.05)}"


@query(f"""{TRUSTED}, marked AS (SELECT s.activity_id, count(*) AS n_high FROM steady s JOIN trusted t ON t.activity_id = s.activity_id AND s.record_index BETWEEN t.start_index AND t.end_index GROUP BY ALL)
SELECT activity_id, round(sum(wheel) / sum(path), 6) AS ratio, round(sum(path), 6) AS trusted_km, any_value(n_high) AS n_high FROM trusted JOIN marked USING (activity_id) WHERE wheel > 0 AND path > 0 GROUP BY activity_id""")
def w17_w18_a13_trusted_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted windows (of 20 s here, under the operator's own rules of acceptance) and the wheel ratio they give."""
    records = A.steady_records(spark, sf_dir)
    windows = materialize(segments.trusted_speed_windows(records, seconds=20.0, min_km=0.05), "trusted")
    shares = segments.speed_confidence(records, windows).groupBy("activity_id").agg(F.count_if(F.col("confidence") == "high").alias("n_high"))
    return rounded(segments.wheel_ratio(windows).join(shares, "activity_id"), "ratio", "trusted_km")


@query(f"""{TERRAIN}, parts AS (SELECT activity_id, min(record_index) AS start_index, max(record_index) AS end_index FROM truns GROUP BY activity_id, run
), inside AS (SELECT r.activity_id, p.start_index AS segment_start, r.record_index, r.elapsed_ms, r.elapsed_s, CASE WHEN p.start_index % 2 = 0 THEN r.heart_rate ELSE r.power END AS effort
  FROM records r JOIN parts p ON p.activity_id = r.activity_id AND r.record_index BETWEEN p.start_index AND p.end_index), {_chain("inside", 3000, "activity_id", "segment_start")}
, placed AS (SELECT x.*, last_value(l.i IGNORE NULLS) OVER (PARTITION BY x.activity_id, x.segment_start ORDER BY x.record_index ROWS UNBOUNDED PRECEDING) AS win
  FROM inside x LEFT JOIN inside_links l ON l.activity_id = x.activity_id AND l.segment_start = x.segment_start AND l.i = x.record_index)
SELECT activity_id, segment_start, min(record_index) AS start_index, max(record_index) AS end_index, arg_min(elapsed_s, record_index) AS start_s, arg_max(elapsed_s, record_index) AS end_s, round(avg(effort), 6) AS effort
FROM placed GROUP BY activity_id, segment_start, win""")
def w14_effort_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 3 s within the terrain runs, of heart rate where a run begins at an even index, else of power."""
    records = A.records(spark, sf_dir)
    marked = series.mark_intervals(series.grade_series_pct(series.compute_grade(records)), series.detect_stops(records, least=2.0))
    runs = series.terrain_runs(series.terrain_state(marked)).withColumn("effort_basis", F.when(F.col("start_index") % 2 == 0, "hr").otherwise("power"))
    return rounded(segments.effort_windows(records, runs, seconds=3.0), "effort")


def _repaired(c: str, n: str, f: str, most: float, ratio: float) -> str:
    """The despiked value of a row whose repaired predecessor is ``f`` and whose successor is ``n``."""
    mid = f"({f} + {n}) / 2"
    size = f"greatest(1, abs({mid}))"
    return f"CASE WHEN {n} IS NOT NULL AND abs({n} - {f}) / {size} < {ratio} AND abs({c} - {mid}) > {most} AND abs({c} - {mid}) / {size} > {ratio} THEN {mid} ELSE {c} END"


DECOUPLING = f"""{R}, v AS (SELECT activity_id, row_number() OVER ({W_}) AS i, elapsed_ms, elapsed_s AS t, power AS c, heart_rate AS h, lead(power) OVER ({W_}) AS cn, lead(heart_rate) OVER ({W_}) AS hn FROM records
  WHERE elapsed_s IS NOT NULL AND power >= 0 AND heart_rate > 0
), d AS (
  SELECT activity_id, i, elapsed_ms, t, c AS p, h AS q FROM v WHERE i = 1
  UNION ALL
  SELECT v.activity_id, v.i, v.elapsed_ms, v.t, {_repaired('v.c', 'v.cn', 'd.p', 250, 0.6)}, {_repaired('v.h', 'v.hn', 'd.q', 25, 0.25)} FROM d JOIN v ON v.activity_id = d.activity_id AND v.i = d.i + 1
), means AS (SELECT x.activity_id, x.i, x.t, avg(y.p) AS p, avg(y.q) AS q FROM d x JOIN d y ON y.activity_id = x.activity_id AND y.i <= x.i AND y.t > x.t - 60 GROUP BY ALL
), e AS (SELECT activity_id, t, least(greatest(p / 200, 0), 2) AS f, least(greatest((q - 50) / 140, 0), 2) AS r, count(*) OVER (PARTITION BY activity_id) AS n FROM means
), g AS (SELECT activity_id, r / f AS x, t <= min(t) OVER o + (max(t) OVER o - min(t) OVER o) / 2 AS early FROM e WHERE n >= 10 AND f >= 0.05 AND r > 0 WINDOW o AS (PARTITION BY activity_id)
), s AS (SELECT activity_id, count(*) FILTER (WHERE early) AS na, count(*) FILTER (WHERE NOT early) AS nb, avg(x) FILTER (WHERE early) AS a, avg(x) FILTER (WHERE NOT early) AS b FROM g GROUP BY activity_id)
SELECT activity_id, CASE WHEN na >= 4 AND nb >= 4 AND a > 0 THEN (b - a) / a * 100 ELSE 0 END AS decoupling_pct FROM (SELECT DISTINCT activity_id FROM records) i LEFT JOIN s USING (activity_id)"""


def _segment_sums(parts: str, name: str) -> str:
    """CTE ``name``: what the records of every row of ``parts`` come to."""
    return f"""{name} AS (
  SELECT p.*, x.* EXCLUDE (activity_id, start_index), v IS NOT NULL AND terrain = 'descent' AND g <= -8 AND CASE WHEN v > 0 THEN sd / v ELSE 0 END >= 0.25 AS technical
  FROM {parts} p JOIN (
    SELECT p.activity_id, p.start_index, arg_min(elapsed_s, record_index) AS start_s, arg_max(elapsed_s, record_index) AS end_s, avg(speed_kmh) AS v, stddev_pop(speed_kmh) AS sd, avg(heart_rate) FILTER (WHERE heart_rate > 0) AS hr,
      avg(power) FILTER (WHERE power >= 0) AS pw, avg(grade_pct) AS g, coalesce(sum(rise) FILTER (WHERE record_index > p.start_index), 0) AS up, avg(CAST(high AS INT)) AS sure
    FROM {parts} p JOIN prepped r ON r.activity_id = p.activity_id AND r.record_index BETWEEN p.start_index AND p.end_index GROUP BY ALL) x ON x.activity_id = p.activity_id AND x.start_index = p.start_index)"""


_COST = """CASE WHEN parts[k].n > 0 AND parts[k + 1].n > 0 THEN parts[k].n * parts[k + 1].n / (parts[k].n + parts[k + 1].n) * pow(parts[k].s / parts[k].n - parts[k + 1].s / parts[k + 1].n, 2) ELSE 0 END"""
_DRIFT, _DRIFT_END = DECOUPLING[len(R) :].replace("FROM records", "FROM drifting").rsplit("\nSELECT activity_id, CASE", 1)
#: Macro segments with their effort signal; windows of 10 s; bottom-up merging of neighbours while the least cost is within the
#: threshold; parts under 20 s absorbed; drift of parts of 40 s and more with a power signal.
SEGMENTS = f"""{MACROS}, {trusted_sql('records', 180001, 1.0)}
, prepped AS (SELECT *, greatest(alt - lag(alt) OVER ({W_}), 0) AS rise FROM (
  SELECT q.* EXCLUDE (alt, rise), coalesce(avg(q.altitude_m) OVER ({W_} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), q.altitude_m) AS alt, EXISTS (SELECT 1 FROM trusted w WHERE w.activity_id = q.activity_id AND q.record_index BETWEEN w.start_index AND w.end_index) AS high FROM gseries q) t
), {_segment_sums('macros', 'msums')}
, told AS (SELECT activity_id, terrain, start_index, end_index, split_part(e, ':', 1) AS effort_basis, split_part(e, ':', 2) AS effort_reason FROM (
  SELECT *, CASE WHEN terrain = 'stopped' THEN 'none:stopped'
    WHEN activity_id % 3 = 0 THEN CASE WHEN technical THEN 'none:a technical descent tells no effort' WHEN pw IS NOT NULL THEN 'power:measured' WHEN hr IS NOT NULL THEN 'hr:power is missing' ELSE 'none:nothing to go by' END
    WHEN hr IS NULL THEN 'none:nothing to go by' WHEN activity_id % 3 = 1 THEN 'hr:no pace by grade is known' ELSE 'hr:this sport is told by heart rate' END AS e FROM msums) t
), efforts AS (SELECT r.activity_id, m.start_index AS seg, r.record_index, r.elapsed_ms, r.elapsed_s, CASE m.effort_basis WHEN 'hr' THEN r.heart_rate ELSE r.power END AS x
  FROM records r JOIN told m ON m.activity_id = r.activity_id AND m.effort_basis <> 'none' AND r.record_index BETWEEN m.start_index AND m.end_index), {_chain("efforts", 10000, "activity_id", "seg")}
, windowed AS (SELECT activity_id, seg, row_number() OVER (PARTITION BY activity_id, seg ORDER BY win) AS wn, i, j, s, e, x FROM (
  SELECT activity_id, seg, win, min(record_index) AS i, max(record_index) AS j, arg_min(elapsed_s, record_index) AS s, arg_max(elapsed_s, record_index) AS e, avg(x) AS x FROM (
    SELECT q.*, last_value(l.i IGNORE NULLS) OVER (PARTITION BY q.activity_id, q.seg ORDER BY q.record_index ROWS UNBOUNDED PRECEDING) AS win
    FROM efforts q LEFT JOIN efforts_links l ON l.activity_id = q.activity_id AND l.seg = q.seg AND l.i = q.record_index) t GROUP BY ALL) t
), merging AS (
  SELECT activity_id, seg, 0 AS step, 3 * pow(0.1 * abs(coalesce(nullif(median(x), 0), 1)), 2) AS most, list(struct_pack(a := wn, b := wn, n := CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, s := coalesce(x, 0)) ORDER BY wn) AS parts FROM windowed GROUP BY activity_id, seg
  UNION ALL
  SELECT activity_id, seg, step + 1, most, list_concat(list_concat(parts[1:pos - 1], [struct_pack(a := parts[pos].a, b := parts[pos + 1].b, n := parts[pos].n + parts[pos + 1].n, s := parts[pos].s + parts[pos + 1].s)]), parts[pos + 2:])
  FROM (SELECT *, list_position(costs, list_min(costs)) AS pos FROM (SELECT *, list_transform(range(1, len(parts)), lambda k: {_COST}) AS costs FROM merging WHERE len(parts) > 1) t WHERE list_min(costs) <= most) t
), pieces AS (SELECT p.activity_id, p.seg, p.q, f.i, f.s, l.j, l.e FROM (
    SELECT activity_id, seg, unnest(parts) AS part, generate_subscripts(parts, 1) AS q FROM (SELECT activity_id, seg, arg_max(parts, step) AS parts FROM merging GROUP BY activity_id, seg) t) p
  JOIN windowed f ON f.activity_id = p.activity_id AND f.seg = p.seg AND f.wn = p.part.a JOIN windowed l ON l.activity_id = p.activity_id AND l.seg = p.seg AND l.wn = p.part.b
), absorbed AS (
  SELECT activity_id, seg, q, 1 AS k, s, e FROM pieces WHERE q = 1
  UNION ALL
  SELECT p.activity_id, p.seg, p.q, CASE WHEN a.e - a.s >= 20 THEN a.k + 1 ELSE a.k END, CASE WHEN a.e - a.s >= 20 THEN p.s ELSE a.s END, p.e FROM absorbed a JOIN pieces p ON p.activity_id = a.activity_id AND p.seg = a.seg AND p.q = a.q + 1
), grouped AS (SELECT activity_id, seg, q, CASE WHEN k > 1 AND k = max(k) OVER o AND NOT coalesce(max(e) OVER o - max(s) OVER o >= 20, false) THEN k - 1 ELSE k END AS k FROM absorbed WINDOW o AS (PARTITION BY activity_id, seg)
), fine AS (
  SELECT g.activity_id, min(p.i) AS start_index, any_value(m.terrain) AS terrain, max(p.j) AS end_index, any_value(m.effort_basis) AS effort_basis, any_value(m.effort_reason) AS effort_reason
  FROM grouped g JOIN pieces p ON p.activity_id = g.activity_id AND p.seg = g.seg AND p.q = g.q JOIN told m ON m.activity_id = g.activity_id AND m.start_index = g.seg GROUP BY g.activity_id, g.seg, g.k
  UNION ALL
  SELECT activity_id, start_index, terrain, end_index, effort_basis, effort_reason FROM told WHERE effort_basis = 'none'
), {_segment_sums('fine', 'fsums')}
, drifting AS (SELECT r.* REPLACE (r.activity_id * 1000000 + f.start_index AS activity_id) FROM records r JOIN fsums f ON f.activity_id = r.activity_id AND r.record_index BETWEEN f.start_index AND f.end_index WHERE f.effort_basis IN ('power', 'vpower') AND f.end_s - f.start_s >= 40
){_DRIFT}, drifts AS (SELECT activity_id, CASE{_DRIFT_END}
), segments AS (
  SELECT f.activity_id, f.start_index, f.terrain, f.end_index, f.effort_basis, f.effort_reason, f.start_s, f.end_s, f.end_s - f.start_s AS duration_s, CASE WHEN f.terrain <> 'stopped' THEN floor(g * 10 + 0.5) / 10 END AS avg_grade,
    CASE WHEN f.terrain <> 'stopped' THEN floor(up + 0.5) END AS elev_gain_m, CASE WHEN f.terrain <> 'stopped' THEN floor(v * 10 + 0.5) / 10 END AS avg_speed_kmh, floor(hr + 0.5) AS avg_hr, CASE WHEN f.terrain <> 'stopped' THEN floor(pw + 0.5) END AS avg_power,
    hr IS NOT NULL AS has_hr, pw IS NOT NULL AS has_power, CASE WHEN sure >= 0.8 THEN 'high' ELSE 'low' END AS speed_confidence, coalesce(technical, false) AS technical,
    CASE WHEN x.decoupling_pct <> 0 THEN floor(x.decoupling_pct * 10 + 0.5) / 10 END AS hr_drift_pct, row_number() OVER (PARTITION BY f.activity_id ORDER BY f.start_index) - 1 AS segment
  FROM fsums f LEFT JOIN drifts x ON x.activity_id = f.activity_id * 1000000 + f.start_index)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = bucketed(A.records(spark, sf_dir), "ride_records", "activity_id", placed=True)
    built = segments.build_segments(records, _context(spark, sf_dir), min_seconds=20.0, drift_s=40.0, least=2.0)
    return materialize(built, "segments")


@query(f"{SEGMENTS} SELECT * REPLACE (round(duration_s, 6) AS duration_s) FROM segments")
def w14_w16_a14_a16_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All effort segments of the rides, with shorter least durations."""
    return rounded(_segments(spark, sf_dir), "duration_s")


@query(f"""{SEGMENTS}, kept AS (
  SELECT *, row_number() OVER o AS p, count(*) OVER (PARTITION BY activity_id) AS total, CASE WHEN effort_basis IN ('power', 'vpower') THEN avg_power WHEN effort_basis = 'hr' THEN avg_hr END AS val
  FROM segments WHERE terrain <> 'stopped' OR duration_s >= 300 WINDOW o AS (PARTITION BY activity_id ORDER BY segment)
), alike AS (SELECT a.activity_id, a.p, b.p AS q, a.terrain = b.terrain AND a.effort_basis = b.effort_basis AND abs(a.duration_s - b.duration_s) <= greatest(a.duration_s, b.duration_s) * 25 / 100
    AND (a.val IS NULL OR b.val IS NULL OR abs(a.val - b.val) <= greatest(a.val, b.val) * 10 / 100) AS same FROM kept a JOIN kept b ON b.activity_id = a.activity_id AND b.p > a.p
), pairs AS (SELECT x.activity_id, x.p, (x.q - x.p) // 2 AS n, x.same AND y.same AS same FROM alike x JOIN alike y ON y.activity_id = x.activity_id AND y.p = x.p + 1 AND y.q = x.q + 1 WHERE (x.q - x.p) % 2 = 0
), sized AS (
  SELECT k.activity_id, k.p, k.segment, coalesce((SELECT min(q) FROM alike x WHERE x.activity_id = k.activity_id AND x.p = k.p AND NOT x.same), k.total + 1) - k.p AS one,
    coalesce((SELECT min(n) FROM pairs x WHERE x.activity_id = k.activity_id AND x.p = k.p AND NOT x.same), greatest(1, (k.total - k.p + 1) // 2)) AS two FROM kept k
), chosen AS (SELECT *, CASE WHEN two >= 2 AND (one < 3 OR two * 2 > one) THEN 2 ELSE 1 END AS period, CASE WHEN two >= 2 AND (one < 3 OR two * 2 > one) THEN two WHEN one >= 3 THEN one ELSE 1 END AS repeats FROM sized
), lines AS (SELECT * FROM chosen WHERE p = 1 UNION ALL SELECT c.* FROM lines l JOIN chosen c ON c.activity_id = l.activity_id AND c.p = l.p + l.period * l.repeats)
SELECT activity_id, segment AS first_segment, period, repeats FROM lines""")
def a17_similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the segments of a ride collapse to, short stops left out."""
    return segments.group_similar(_segments(spark, sf_dir).where("terrain <> 'stopped' OR duration_s >= 300"))


@query()
def a17_a23_segment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.segment_context(_segments(spark, sf_dir))


@query(f"SELECT activity_id, round(decoupling_pct, 6) AS decoupling_pct FROM ({DECOUPLING})")
def a4_decoupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power.decoupling(A.records(spark, sf_dir), _context(spark, sf_dir)), "decoupling_pct")


SUMMARY = f"""{A.with_ctes("records", "activities")}, base AS (
  SELECT activity_id, count(*) AS n_records, coalesce(max(distance_km), 0) AS km, coalesce(max(elapsed_s), 0) AS secs, coalesce(avg(power) FILTER (WHERE power >= 0), 0) AS avg_power, coalesce(max(power) FILTER (WHERE power >= 0), 0) AS max_power,
    coalesce(avg(cadence) FILTER (WHERE cadence > 0), 0) AS avg_cadence, coalesce(max(cadence) FILTER (WHERE cadence > 0), 0) AS max_cadence, avg(heart_rate) FILTER (WHERE heart_rate > 0) AS hr, max(heart_rate) FILTER (WHERE heart_rate > 0) AS top,
    coalesce(avg(speed_kmh) FILTER (WHERE speed_kmh > 0), 0) AS v FROM records GROUP BY activity_id
), told AS (
  SELECT b.*, coalesce(s.total_distance_km, b.km) AS distance_km, coalesce(s.total_timer_s, b.secs) AS duration_s, coalesce(b.hr, s.avg_hr, 0) AS avg_hr, coalesce(b.top, s.max_hr, 0) AS max_hr,
    CASE WHEN s.avg_speed_kmh > 0 THEN s.avg_speed_kmh END AS own_avg, CASE WHEN s.max_speed_kmh > 0 THEN s.max_speed_kmh END AS own_max FROM base b LEFT JOIN activities s USING (activity_id)
), rolled AS (
  SELECT activity_id, avg(power) OVER (PARTITION BY activity_id ORDER BY elapsed_ms RANGE BETWEEN 29999 PRECEDING AND CURRENT ROW) AS m FROM records WHERE power >= 0
), parts AS (
  SELECT t.*, coalesce(np.np, 0) AS np, coalesce(xp.xpower, 0) AS xpower, coalesce(sp.max_speed, 0) AS despiked, coalesce(el.gain_m, 0) AS gain_m, coalesce(el.loss_m, 0) AS loss_m, coalesce(de.decoupling_pct, 0) AS decoupling_pct,
    least(greatest((t.avg_hr - 50) / 140, 0), 1.5) AS r
  FROM told t LEFT JOIN (SELECT activity_id, pow(avg(pow(m, 4)), 0.25) AS np FROM rolled GROUP BY activity_id) np USING (activity_id) LEFT JOIN ({XPOWER}) xp USING (activity_id) LEFT JOIN ({DESPIKED}) sp USING (activity_id)
    LEFT JOIN ({ELEVATION}) el USING (activity_id) LEFT JOIN ({DECOUPLING}) de USING (activity_id))
SELECT activity_id, n_records, distance_km, duration_s, CASE WHEN own_avg IS NOT NULL THEN own_avg WHEN distance_km > 0 AND duration_s > 0 THEN distance_km / (duration_s / 3600) ELSE v END AS avg_speed, coalesce(own_max, despiked) AS max_speed,
  avg_power, max_power, avg_cadence, max_cadence, avg_hr, max_hr, np, np / 200 AS intensity, CASE WHEN duration_s > 0 THEN duration_s * np * (np / 200) / (200 * 3600) * 100 ELSE 0 END AS tss,
  xpower, xpower / 200 AS relative_intensity, CASE WHEN duration_s > 0 THEN duration_s * xpower * (xpower / 200) / (200 * 3600) * 100 ELSE 0 END AS bike_stress, decoupling_pct,
  CASE WHEN duration_s > 0 THEN duration_s / 60 * r * 0.64 * exp(1.92 * r) ELSE 0 END AS trimp, CASE WHEN duration_s > 0 THEN duration_s / 3600 * r * r * 100 ELSE 0 END AS hr_tss, gain_m, loss_m FROM parts"""


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all test activities; their parts share one written table of records."""
    return summary.activity_summary(materialize(A.records(spark, sf_dir), "records"), _context(spark, sf_dir), A.activities(spark, sf_dir))


@query(f"SELECT activity_id, n_records, round(COLUMNS(* EXCLUDE (activity_id, n_records)), 6) FROM ({SUMMARY})")
def a1_activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _summaries(spark, sf_dir)
    return rounded(out, *[c for c in out.columns if c not in ("activity_id", "n_records")])


@query(f"""WITH m AS ({SUMMARY}), p AS (SELECT activity_id AS left_id, lead(activity_id) OVER (ORDER BY activity_id) AS right_id FROM m
), l AS (UNPIVOT (SELECT activity_id, CAST(COLUMNS(* EXCLUDE activity_id) AS DOUBLE) FROM m) ON COLUMNS(* EXCLUDE activity_id) INTO NAME measure VALUE value)
SELECT left_id, right_id, a.measure, round(a.value, 6) AS left_value, round(b.value, 6) AS right_value FROM p JOIN l a ON a.activity_id = left_id JOIN l b ON b.activity_id = right_id AND b.measure = a.measure""")
def j9_compare_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every activity beside the next one by id."""
    measures = materialize(_summaries(spark, sf_dir), "summaries")
    return rounded(summary.compare_activities(measures, summary.next_activities(_context(spark, sf_dir))), "left_value", "right_value")


@query(f"""{R} SELECT activity_id, count(*) AS n_records, round(sum(elapsed_s), 6) AS sum_elapsed FROM records GROUP BY activity_id""")
def p15_activity_with_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested export rows, told by the number and sum of their records."""
    records = A.records(spark, sf_dir)
    owners = records.select("activity_id").distinct().select("activity_id", F.lit(0).alias("athlete_id"), F.lit(None).cast("double").alias("manual_avg_hr"), F.lit(120.0).alias("avg_hr"))
    nested = summary.activity_with_records(owners, records)
    total = F.aggregate(F.transform("records", lambda r: r["elapsed_s"]), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return rounded(nested.select("activity_id", F.size("records").cast("long").alias("n_records"), total.alias("sum_elapsed")), "sum_elapsed")


@query(f"""{ZONES}, l AS (SELECT activity_id, zone, round(s, 6) AS s, round(s / nullif(sum(s) OVER (PARTITION BY activity_id), 0) * 100, 9) AS p,
    CASE WHEN activity_id % 2 = 0 THEN [95, 120, 140, 160, 175, 191] ELSE [95, 114, 133, 152, 171, 191] END AS low FROM f)
SELECT activity_id, CASE WHEN sum(s) > 0 THEN '**Time in Heart-Rate Zones:**' || chr(10) || string_agg('- Zone ' || CAST(zone AS VARCHAR) || ' (' || CAST(low[zone] AS VARCHAR) || '-' || CAST(low[zone + 1] - 1 AS VARCHAR) || ' bpm): '
    || printf('%02d:%02d:%02d', CAST(floor(s + 0.5) AS BIGINT) // 3600, CAST(floor(s + 0.5) AS BIGINT) % 3600 // 60, CAST(floor(s + 0.5) AS BIGINT) % 60) || ' (' || CAST(CAST(floor(p + 0.5) AS BIGINT) AS VARCHAR) || '%)', chr(10) ORDER BY zone)
  ELSE '**Time in Heart-Rate Zones:** Not available.' END AS text FROM l GROUP BY activity_id""")
def a25_zone_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = _limits(spark, sf_dir)
    return summary.zone_context(heart.hr_zone_time(A.records(spark, sf_dir), limits), limits)
