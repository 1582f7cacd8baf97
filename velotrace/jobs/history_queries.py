"""Queries over activities, profiles, analyses and chats: joins, upserts, scalars and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import text as X
from ..functions.shared import bucketed, materialize, shared_folder
from ..operators import heart, history, maintain, segments, suggestion, summary
from ..sources import adapters as A
from . import series_queries as Q
from .registry import ORACLE_SQL, query, rounded

ACT = A.with_ctes("activities")


@query(f"""{A.with_ctes('activities', 'profiles')}, latest AS (SELECT athlete_id, arg_max(max_hr, effective_day) AS m, max(effective_day) AS d FROM profiles GROUP BY athlete_id
), found AS (SELECT a.activity_id, arg_max(p.max_hr, p.effective_day) AS m, max(p.effective_day) AS d FROM activities a JOIN profiles p ON p.athlete_id = a.athlete_id AND p.effective_day <= a.start_s // 86400 GROUP BY a.activity_id)
SELECT a.activity_id, coalesce(f.d, l.d) AS effective_day, coalesce(f.m, l.m) AS max_hr, CASE WHEN a.start_s IS NULL THEN l.m ELSE f.m END AS ingest_max_hr
FROM activities a LEFT JOIN found f USING (activity_id) LEFT JOIN latest l USING (athlete_id)""")
def j1_j2_profile_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    activities, profiles = A.activities(spark, sf_dir), A.hr_profiles(spark, sf_dir)
    shown = heart.hr_profile_as_of(activities, profiles).select("activity_id", "profile.effective_day", "profile.max_hr")
    ingest = heart.hr_profile_as_of(activities, profiles, fallback=False).select("activity_id", F.col("profile.max_hr").alias("ingest_max_hr"))
    return shown.join(ingest, "activity_id")


@query(f"""{A.with_ctes('activities', 'athletes')} SELECT a.activity_id, coalesce(a.rider_mass_kg, t.rider_mass_kg) AS rider_mass_kg, coalesce(a.bike_mass_kg, t.bike_mass_kg) AS bike_mass_kg FROM activities a LEFT JOIN athletes t USING (athlete_id)""")
def j3_effective_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.effective_mass(A.activities(spark, sf_dir), A.athletes(spark, sf_dir))


PAIRS = f"""{ACT}, pairs AS (
  SELECT a.activity_id, a.start_s, p.activity_id AS p_id, p.start_s AS p_start_s, p.total_distance_km AS km, p.total_timer_s AS secs, p.avg_speed_kmh AS v, p.max_speed_kmh AS vmax, coalesce(p.manual_avg_hr, p.avg_hr) AS hr, p.max_hr, p.total_ascent_m AS up
  FROM activities a JOIN activities p ON p.athlete_id = a.athlete_id AND (p.start_s < a.start_s OR (p.start_s = a.start_s AND p.activity_id < a.activity_id))
  WHERE a.total_distance_km > 0 AND p.total_distance_km BETWEEN a.total_distance_km * 0.75 AND a.total_distance_km * 1.25)"""


@query(f"{PAIRS} SELECT activity_id, p_id AS p_activity_id, p_start_s FROM pairs")
def j4_comparable_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.comparable_rides(A.activities(spark, sf_dir)).select("activity_id", "p_activity_id", "p_start_s")


def _trend(name: str, value: str, unit: str) -> str:
    return f"""{name} AS (SELECT activity_id, (b - a) / a * 100 AS c FROM (
  SELECT activity_id, avg(x) FILTER (WHERE i < n // 2) AS a, avg(x) FILTER (WHERE i >= n // 2) AS b FROM (
    SELECT activity_id, {value} AS x, row_number() OVER (PARTITION BY activity_id ORDER BY p_start_s, p_id) - 1 AS i, count(*) OVER (PARTITION BY activity_id) AS n FROM pairs WHERE {value} > 0) t WHERE n >= 4 GROUP BY activity_id) t),
  {name}_text AS (SELECT activity_id, CASE WHEN c > 2 THEN 'rising' WHEN c < -2 THEN 'falling' ELSE 'stable' END || ' (' || CASE WHEN c >= 0 THEN '+' ELSE '' END || printf('%.1f', floor(round(c, 9) * 10 + 0.5) / 10) || '%, {unit})' AS t FROM {name})"""


@query(f"""{PAIRS}, totals AS (SELECT activity_id, count(*) AS n, sum(km) AS km, sum(secs) / 3600.0 AS hours, avg(v) FILTER (WHERE v > 0) AS v, avg(hr) FILTER (WHERE hr > 0) AS hr, max(max_hr) AS mhr, max(p_start_s) AS last, max(vmax) AS vmax, max(up) AS up FROM pairs GROUP BY activity_id
), {_trend('speed', 'v', 'km/h')}, {_trend('rate', 'hr', 'bpm')}, recent AS (
  SELECT a.activity_id, count(*) FILTER (WHERE p.start_s >= a.start_s - 7 * 86400) AS n_7, sum(p.total_distance_km) FILTER (WHERE p.start_s >= a.start_s - 7 * 86400) AS km_7,
    avg(p.avg_speed_kmh) FILTER (WHERE p.start_s >= a.start_s - 7 * 86400 AND p.avg_speed_kmh > 0) AS v_7, count(*) FILTER (WHERE p.start_s >= a.start_s - 28 * 86400) AS n_28
  FROM activities a JOIN activities p ON p.athlete_id = a.athlete_id AND (p.start_s < a.start_s OR (p.start_s = a.start_s AND p.activity_id < a.activity_id)) GROUP BY a.activity_id)
SELECT a.activity_id, round(a.total_distance_km * 0.75, 9) AS min_km, round(a.total_distance_km * 1.25, 9) AS max_km, coalesce(t.n, 0) AS n_prior, round(coalesce(t.km, 0), 6) AS km, round(coalesce(t.hours, 0), 9) AS hours, round(coalesce(t.v, 0), 6) AS avg_speed,
  round(coalesce(t.hr, 0), 6) AS avg_hr, coalesce(t.mhr, 0) AS max_hr, coalesce(t.vmax, 0) AS best_speed, coalesce(t.up, 0) AS best_ascent, t.last AS last_start_s, coalesce(r.n_7, 0) AS n_7, round(coalesce(r.km_7, 0), 6) AS km_7, round(coalesce(r.v_7, 0), 6) AS speed_7,
  round(least(100.0, coalesce(r.n_28, 0) * 100.0 / 16), 6) AS consistency_pct, coalesce(s.t, 'insufficient data') AS trend_speed, coalesce(h.t, 'insufficient data') AS trend_hr
FROM activities a LEFT JOIN totals t USING (activity_id) LEFT JOIN recent r USING (activity_id) LEFT JOIN speed_text s USING (activity_id) LEFT JOIN rate_text h USING (activity_id) WHERE a.start_s IS NOT NULL""")
def j5_a22_progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rounded(history.progress_summary(A.activities(spark, sf_dir)), "min_km", "max_km", "hours", digits=9)
    return rounded(wide, "km", "avg_speed", "avg_hr", "km_7", "speed_7", "consistency_pct")


RECENT = f"""{A.with_ctes('activities', 'analyses')}, done AS (SELECT * FROM activities WHERE activity_id IN (SELECT activity_id FROM analyses) AND start_s IS NOT NULL
), pairs AS (SELECT a.activity_id, o.activity_id AS other_id, o.start_s AS other_start_s FROM activities a JOIN done o ON o.athlete_id = a.athlete_id AND o.start_s < a.start_s AND o.start_s >= (a.start_s - 30 * 86400) // 86400 * 86400
), single AS (SELECT a.activity_id, max(struct_pack(s := o.start_s, i := o.activity_id)) AS l FROM activities a JOIN done o ON o.athlete_id = a.athlete_id AND o.start_s < a.start_s GROUP BY a.activity_id
), recent AS (SELECT * FROM pairs UNION ALL SELECT activity_id, l.i, l.s FROM single WHERE activity_id NOT IN (SELECT activity_id FROM pairs))"""


@query(f"{RECENT} SELECT activity_id, other_id, other_start_s FROM recent")
def j6_recent_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent_analyses(A.activities(spark, sf_dir), A.analyses(spark, sf_dir))


@query(f"{A.with_ctes('activities', 'analyses')} SELECT a.activity_id, a.start_s, n.analysis_version FROM activities a LEFT JOIN analyses n USING (activity_id) WHERE n.analysis_version IS NULL OR n.analysis_version < 5")
def j7_outdated_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.outdated_analyses(A.activities(spark, sf_dir), A.analyses(spark, sf_dir), 5)


@query(f"{A.with_ctes('analyses')} SELECT activity_id, max(analysis_version) AS latest_version, max(CAST(analysis_version = 5 AS INT)) = 1 AS is_current FROM analyses GROUP BY activity_id")
def j10_current_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.current_and_latest_analysis(A.analyses(spark, sf_dir), 5)


@query(f"{ACT} SELECT activity_id, start_s, imported_s, coalesce(manual_avg_hr, avg_hr) AS hr FROM activities")
def t1_activity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.activity_list(A.activities(spark, sf_dir))


def _samples(activities: DataFrame) -> DataFrame:
    rows = activities.where("start_s IS NOT NULL")
    return rows.select("athlete_id", "activity_id", "start_s", (0.97 + F.col("activity_id") % 7 * 0.01).alias("ratio"), (F.col("total_distance_km") / 10).alias("trusted_km"))


@query(f"""{A.with_ctes('activities', 'athletes')}, s AS (SELECT athlete_id, 0.97::DOUBLE + activity_id % 7 * 0.01::DOUBLE AS ratio, total_distance_km / 10 AS km, row_number() OVER w AS n, coalesce(sum(total_distance_km / 10) OVER (PARTITION BY athlete_id ORDER BY start_s DESC, activity_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM activities WHERE start_s IS NOT NULL WINDOW w AS (PARTITION BY athlete_id ORDER BY start_s DESC, activity_id DESC)
), g AS (SELECT athlete_id, sum(km) AS t, sum(ratio * km) / sum(km) AS r FROM s WHERE n <= 15 AND prior < 20 GROUP BY athlete_id)
SELECT athlete_id, floor(r * 10000 + 0.5) / 10000 AS ratio, floor((r - 1) * 100 * 10 + 0.5) / 10 AS deviation_pct, floor(t * 10 + 0.5) / 10 AS trusted_km, wheel_mm AS current_mm, floor(wheel_mm / r * 10 + 0.5) / 10 AS recommended_mm
FROM g LEFT JOIN athletes USING (athlete_id) WHERE t >= 15 AND abs(r - 1) * 100 > 1""")
def t3_wheel_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.wheel_recommendation(_samples(A.activities(spark, sf_dir)), A.athletes(spark, sf_dir))


@query(f"{ACT} SELECT file_path FROM activities WHERE activity_id % 3 = 0")
def s1_s3_t6_index_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings without an activity: a third of the rides counts as not indexed yet."""
    activities = A.activities(spark, sf_dir)
    junk = activities.select(F.concat(F.lit(".git/"), "file_path").alias("path")).unionByName(activities.select(F.regexp_replace("file_path", "fit$", "txt").alias("path")))
    files = maintain.recordings(activities.select(F.col("file_path").alias("path")).unionByName(junk)).withColumnRenamed("path", "file_path")
    return maintain.index_new(files, activities.where("activity_id % 3 <> 0"))


@query(f"""{ACT} SELECT activity_id, file_path, total_distance_km + CASE WHEN activity_id % 2 = 0 THEN 1 ELSE 0 END AS total_distance_km,
  CASE WHEN activity_id % 4 = 0 AND rider_mass_kg IS NULL THEN 80 ELSE rider_mass_kg END AS rider_mass_kg, CASE WHEN activity_id % 4 = 0 AND bike_mass_kg IS NULL THEN 9 ELSE bike_mass_kg END AS bike_mass_kg,
  manual_avg_hr, manual_max_hr, sport FROM activities""")
def s4_upsert_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second ride is imported again, twice; the later import counts, one without a time before all others, and a column it lacks stays."""
    cols = ["activity_id", "file_path", "total_distance_km", "rider_mass_kg", "bike_mass_kg", "manual_avg_hr", "manual_max_hr", "imported_s"]
    old = A.activities(spark, sf_dir).select(*cols, "sport")
    masses = {c: F.when(F.col("activity_id") % 4 == 0, kg) for c, kg in (("rider_mass_kg", 80.0), ("bike_mass_kg", 9.0))}
    again = old.select(*cols).where("activity_id % 2 = 0").withColumns({"manual_avg_hr": F.lit(1.0), "manual_max_hr": F.lit(2.0)} | masses)
    late = again.withColumn("total_distance_km", F.col("total_distance_km") + 1)
    early = again.withColumn("imported_s", F.when(F.col("activity_id") % 3 > 0, F.col("imported_s") - 10))
    return maintain.upsert_activities(old, early.unionByName(late)).drop("imported_s")


@query(f"{A.with_ctes('records')} SELECT activity_id, record_index, CASE WHEN activity_id % 5 = 0 THEN 0 ELSE power END AS power FROM records WHERE activity_id % 5 <> 0 OR record_index < 10")
def s5_replace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = A.records(spark, sf_dir).select("activity_id", "record_index", "power")
    return maintain.replace_rows(old, old.where("activity_id % 5 = 0 AND record_index < 10").withColumn("power", F.lit(0.0)))


@query(f"{ACT} SELECT activity_id, CASE WHEN activity_id % 6 = 0 THEN 2 ELSE 1 END AS ratio FROM activities WHERE activity_id % 6 <> 0 OR activity_id % 4 = 0")
def s6_replace_wheel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = A.activities(spark, sf_dir).select("activity_id")
    old = ids.withColumn("ratio", F.lit(1.0))
    imported = ids.where("activity_id % 6 = 0")
    return maintain.replace_wheel_samples(old, imported, imported.withColumn("ratio", F.when(F.col("activity_id") % 4 == 0, 2.0)))


_ENTERED = {
    "sex": "CASE WHEN athlete_id % 7 = 0 THEN 'x' WHEN athlete_id % 17 = 0 THEN NULL ELSE sex END", "age": "CASE WHEN athlete_id % 11 = 0 THEN 9.5 ELSE age END", "resting_hr": "CASE WHEN athlete_id % 13 = 0 THEN 121.0 ELSE resting_hr END",
    "rider_mass_kg": "rider_mass_kg + CASE WHEN athlete_id % 19 = 0 THEN 200.0 ELSE 0.0 END", "bike_mass_kg": "CASE WHEN athlete_id % 5 = 0 THEN NULL WHEN athlete_id % 23 = 0 THEN 2.5 ELSE bike_mass_kg END",
    "ftp": "CASE WHEN athlete_id % 29 = 0 THEN 79.0 WHEN athlete_id % 6 = 0 THEN NULL ELSE ftp END", "wheel_mm": "CASE WHEN athlete_id % 31 = 0 THEN 2501.0 ELSE wheel_mm END",
}


@query(f"""{A.with_ctes('athletes')}, entered AS (SELECT athlete_id, {', '.join(f'{e} AS {c}' for c, e in _ENTERED.items())} FROM athletes
), told AS (SELECT *, array_to_string(list_filter([CASE WHEN (sex IS NULL) <> (age IS NULL) OR (age IS NULL) <> (resting_hr IS NULL) THEN 'together' END, CASE WHEN sex NOT IN ('male', 'female', 'other') THEN 'sex' END, CASE WHEN age NOT BETWEEN 10 AND 100 THEN 'age' END,
  CASE WHEN resting_hr NOT BETWEEN 30 AND 120 THEN 'resting_hr' END, CASE WHEN rider_mass_kg NOT BETWEEN 30 AND 250 THEN 'rider_mass_kg' END, CASE WHEN bike_mass_kg NOT BETWEEN 3 AND 50 THEN 'bike_mass_kg' END, CASE WHEN ftp NOT BETWEEN 80 AND 500 THEN 'ftp' END,
  CASE WHEN wheel_mm NOT BETWEEN 1000 AND 2500 THEN 'wheel_mm' END], lambda x: x IS NOT NULL), ',') AS failed FROM entered)
SELECT athlete_id, failed, CASE WHEN failed = '' THEN age END AS age, CASE WHEN failed = '' THEN ftp END AS ftp FROM told""")
def p10_profiles_set_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entered profiles, some of them wrong: sound ones with their values, the others with the rules they break."""
    entered = A.athletes(spark, sf_dir).selectExpr("athlete_id", *[f"{e} AS {c}" for c, e in _ENTERED.items()])
    good, bad = S.set_apart(entered, S.PROFILE_RULES)
    none = F.lit(None).cast("double")
    return good.select("athlete_id", F.lit("").alias("failed"), "age", "ftp").unionByName(bad.select("athlete_id", F.array_join("failed", ",").alias("failed"), none.alias("age"), none.alias("ftp")))


@query(f"{A.with_ctes('athletes')} SELECT athlete_id, CASE WHEN athlete_id % 3 = 0 THEN 61 ELSE age END AS age, resting_hr, CASE WHEN athlete_id % 2 = 0 THEN 222 ELSE ftp END AS ftp FROM athletes")
def s7_patch_athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of patches is folded and laid over the stored profiles; NULL leaves a value."""
    old = A.athletes(spark, sf_dir).select("athlete_id", "age", "resting_hr", "ftp")
    one = old.where("athlete_id % 3 = 0").select("athlete_id", F.lit(1).alias("at"), F.lit(61.0).alias("age"), F.lit(None).cast("double").alias("resting_hr"), F.lit(None).cast("double").alias("ftp"))
    two = old.where("athlete_id % 2 = 0").select("athlete_id", F.lit(2).alias("at"), F.lit(None).cast("double").alias("age"), F.lit(None).cast("double").alias("resting_hr"), F.lit(222.0).alias("ftp"))
    return maintain.upsert(old, maintain.latest_patch(one.unionByName(two), "athlete_id", "at"), ["athlete_id"], patch=True)


@query(f"""{A.with_ctes('activities', 'profiles')} SELECT athlete_id, effective_day, CASE WHEN athlete_id % 2 = 0 THEN 201 ELSE max_hr END AS max_hr, CASE WHEN athlete_id % 2 = 0 THEN NULL ELSE zone2 END AS zone2, 1 AS created FROM profiles""")
def s8_upsert_hr_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds are replaced, also by NULL; the creation mark stays."""
    old = A.hr_profiles(spark, sf_dir).select("athlete_id", "effective_day", "max_hr", "zone2").withColumn("created", F.lit(1))
    new = old.where("athlete_id % 2 = 0").withColumn("max_hr", F.lit(201).cast(old.schema["max_hr"].dataType)).withColumn("zone2", F.lit(None).cast("int")).withColumn("created", F.lit(2))
    return maintain.upsert(old, new, ["athlete_id", "effective_day"], keep=("created",))


@query(f"""{A.with_ctes('activities', 'analyses')}, ids AS (SELECT activity_id FROM analyses UNION SELECT activity_id FROM activities WHERE activity_id % 100 = 0)
SELECT i.activity_id, CASE WHEN i.activity_id % 100 = 0 THEN 9 ELSE n.analysis_version END AS analysis_version, CASE WHEN n.activity_id IS NULL THEN 2 ELSE 1 END AS created FROM ids i LEFT JOIN analyses n USING (activity_id)""")
def s9_upsert_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = A.analyses(spark, sf_dir).select("activity_id", "analysis_version").withColumn("created", F.lit(1))
    new = A.activities(spark, sf_dir).where("activity_id % 100 = 0").select("activity_id", F.lit(9).cast("long").alias("analysis_version"), F.lit(2).alias("created"))
    return maintain.upsert(old, new, ["activity_id"], keep=("created",))


@query(f"""{A.with_ctes('activities', 'analyses')} SELECT a.activity_id, CASE WHEN a.activity_id % 10 = 0 THEN 133 ELSE a.manual_avg_hr END AS manual_avg_hr, CASE WHEN a.activity_id % 20 = 0 THEN NULL WHEN a.activity_id % 10 = 0 THEN 191 ELSE a.manual_max_hr END AS manual_max_hr,
  CASE WHEN a.activity_id % 8 = 0 THEN NULL ELSE a.rider_mass_kg END AS rider_mass_kg, CASE WHEN a.activity_id % 8 = 0 THEN 12 ELSE a.bike_mass_kg END AS bike_mass_kg,
  n.activity_id IS NOT NULL AND a.activity_id % 10 <> 0 AS analysed FROM activities a LEFT JOIN analyses n USING (activity_id)""")
def s10_s11_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    activities = A.activities(spark, sf_dir)
    edits = activities.where("activity_id % 10 = 0").select("activity_id", F.lit(133.0).alias("manual_avg_hr"), F.when(F.col("activity_id") % 20 != 0, 191.0).alias("manual_max_hr"))
    rows, kept = maintain.override_activity_hr(activities, A.analyses(spark, sf_dir), edits)
    rows = maintain.set_activity_mass(rows, activities.where("activity_id % 8 = 0").select("activity_id", F.lit(None).cast("double").alias("rider_mass_kg"), F.lit(12.0).alias("bike_mass_kg")))
    marks = kept.select("activity_id", F.lit(True).alias("analysed"))
    return rows.join(marks, "activity_id", "left").select("activity_id", "manual_avg_hr", "manual_max_hr", "rider_mass_kg", "bike_mass_kg", F.coalesce("analysed", F.lit(False)).alias("analysed"))


@query(f"{ACT} SELECT activity_id, sport, 0 AS training_load, CAST(NULL AS VARCHAR) AS device FROM activities")
def s12_add_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = A.activities(spark, sf_dir).select("activity_id", "sport")
    return maintain.add_missing_columns(old, {"Sport": ("string", "x"), "training_load": ("int", 0), "device": ("string", None)})


@query("""SELECT strftime(ts, '%Y-%m-%d') AS log_date, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'saved' END AS status, count(*) AS n FROM events
  WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 10 GROUP BY ALL""")
def s13_log_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs are written by day, days beyond the retention go as whole folders, and what is left is counted by day."""
    logs = A.table(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "error", "failed").otherwise("saved").alias("status"))
    path = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    maintain.write_logs(logs, path)
    last = maintain.read_logs(spark, path, "ts timestamp, status string").agg(F.max("log_date").alias("day")).first()["day"]
    maintain.drop_log_days(spark, path, 10, last)
    return maintain.read_logs(spark, path, "ts timestamp, status string").where("broken IS NULL").groupBy(F.col("log_date").cast("string").alias("log_date"), "status").agg(F.count("*").alias("n"))


@query(f"{A.with_ctes('records')} SELECT activity_id, CAST('bike' AS VARCHAR) AS device, CAST(record_index AS INTEGER) AS record_index, elapsed_s, heart_rate, power, CAST(NULL AS DOUBLE) AS cadence FROM records")
def s2_read_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded files with one nested session a ride; the reader's schema has a field that no file has, and lacks one that they have."""
    r = F.struct("record_index", "elapsed_s", "heart_rate", "power", F.lit(1).alias("other"))
    nested = A.records(spark, sf_dir).groupBy("activity_id").agg(F.array_sort(F.collect_list(r)).alias("records"), F.lit("bike").alias("device"))
    path = f"{shared_folder(spark)}/decoded-{uuid.uuid4().hex}"
    nested.withColumn("records", F.transform("records", lambda x: x.dropFields("record_index"))).write.parquet(path)
    schema = T.StructType.fromDDL("activity_id long, device string, records array<struct<elapsed_s: double, heart_rate: double, power: double, cadence: double>>")
    return maintain.read_decoded(spark, path, schema)


@query("SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'saved' END AS status, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS GROUP BY ALL")
def s13_s14_log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved and failed counts of the log rows within ten days of the last one."""
    logs = A.table(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "error", "failed").otherwise("saved").alias("status"))
    return maintain.index_report(maintain.prune_logs(logs, 10, logs.agg(F.max("ts")).scalar()))


@query(f"""{ACT} SELECT activity_id, coalesce(manual_avg_hr, avg_hr) AS hr, coalesce(CASE WHEN avg_speed_kmh > 0 THEN avg_speed_kmh END, CASE WHEN max_speed_kmh > 0 THEN max_speed_kmh END) AS speed_kmh,
  CASE WHEN activity_id % 3 = 2 THEN 'running' ELSE 'cycling' END AS sport,
  array_to_string(list_filter([CASE WHEN avg_hr NOT BETWEEN 30 AND 240 THEN 'avg_hr' END, CASE WHEN max_hr NOT BETWEEN 100 AND 240 THEN 'max_hr' END, CASE WHEN avg_hr > max_hr THEN 'avg_at_most_max' END], lambda x: x IS NOT NULL), ',') AS failed FROM activities""")
def p9_p10_p14_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective measures, sports and broken rules of activities."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return A.activities(spark, sf_dir).select(
        "activity_id", history.effective_hr().alias("hr"), F.coalesce(positive("avg_speed_kmh"), positive("max_speed_kmh")).alias("speed_kmh"), S.normalize_sport("sport").alias("sport"), F.array_join(S.failed_rules(S.ACTIVITY_HR_RULES), ",").alias("failed")
    )


@query(f"""{A.with_ctes('activities', 'profiles')} SELECT athlete_id, effective_day, array_to_string(list_filter([CASE WHEN max_hr NOT BETWEEN 100 AND 240 THEN 'max_hr' END,
  CASE WHEN zone2 >= zone3 OR zone3 >= zone4 OR zone4 >= zone5 THEN 'rising' END, CASE WHEN zone5 > max_hr THEN 'at_most_max' END], lambda x: x IS NOT NULL), ',') AS failed FROM profiles""")
def p10_profile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hr_profiles(spark, sf_dir).select("athlete_id", "effective_day", F.array_join(S.failed_rules(S.THRESHOLD_RULES), ",").alias("failed"))


@query("""WITH c AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS a, embedding[2]::DOUBLE * 4000000000 AS b, CASE WHEN vec_id % 9 = 0 THEN 'x' ELSE CAST(vec_id AS VARCHAR) END AS t FROM embeddings)
SELECT id, round(CASE WHEN abs(a) <= 90 THEN a ELSE CASE WHEN abs(a * 180.0 / 2147483648) <= 90 THEN a * 180.0 / 2147483648 END END, 6) AS lat, round(CASE WHEN abs(b) <= 180 THEN b WHEN abs(b * 180.0 / 2147483648) <= 180 THEN b * 180.0 / 2147483648 END, 6) AS lon, try_cast(t AS DOUBLE) AS number FROM c""")
def p1_p3_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.get("embedding", 0).cast("double") * 1000).alias("a"), (F.get("embedding", 1).cast("double") * 4000000000).alias("b"), F.when(F.col("vec_id") % 9 == 0, "x").otherwise(F.col("vec_id").cast("string")).alias("t")
    )
    return rounded(rows.select("id", S.normalize_coordinate("a", 90).alias("lat"), S.normalize_coordinate("b", 180).alias("lon"), S.as_number("t").alias("number")), "lat", "lon")


HMS = "CASE WHEN {s} // 3600 < 10 THEN '0' ELSE '' END || ({s} // 3600) || ':' || lpad(CAST({s} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0')"


@query(f"""{ACT}, t AS (SELECT *, CAST(floor(total_timer_s + 0.5) AS BIGINT) AS s FROM activities)
SELECT activity_id, {HMS.format(s='s')} AS hms, (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock, strftime(start_ts, '%Y-%m-%d %H:%M') AS started, strftime(start_ts, '%Y-%m-%d') AS day,
  floor(total_distance_km * 10 + 0.5) / 10 AS km1, least(greatest(total_distance_km, 5), 30) AS clamped, CAST(least(greatest(floor(total_timer_s / 3600 * 10 + 0.5), 10), 150) AS DOUBLE) AS budget FROM t""")
def h2_h8_h16_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.activities(spark, sf_dir).select(
        "activity_id", S.format_hms("total_timer_s").alias("hms"), S.format_clock("total_timer_s").alias("clock"), F.date_format("start_ts", "yyyy-MM-dd HH:mm").alias("started"), S.to_date_only(F.col("start_ts").cast("string")).cast("string").alias("day"),
        S.round_to("total_distance_km", 1).alias("km1"), S.clamp("total_distance_km", 5.0, 30.0).alias("clamped"), S.segment_line_budget("total_timer_s").alias("budget"),
    )


@query(f"""{A.with_ctes('activities', 'athletes')}, j AS (SELECT a.*, t.resting_hr, t.sex, t.ftp, 200.0::DOUBLE AS top FROM activities a JOIN athletes t USING (athlete_id)
), r AS (SELECT *, least(greatest((avg_hr - resting_hr) / (top - resting_hr), 0), 1.5) AS q FROM j)
SELECT activity_id, round(180 / ftp, 6) AS intensity, round(total_timer_s * 180 * (180 / ftp) / (ftp * 3600) * 100, 6) AS tss,
  round(total_timer_s / 60 * q * CASE sex WHEN 'male' THEN 0.64 WHEN 'female' THEN 0.86 ELSE 0.75 END * exp(CASE sex WHEN 'male' THEN 1.92 WHEN 'female' THEN 1.67 ELSE 1.795 END * q), 6) AS trimp, round(total_timer_s / 3600 * q * q * 100, 6) AS hr_tss FROM r""")
def h9_h11_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.activities(spark, sf_dir).drop("rider_mass_kg").join(A.athletes(spark, sf_dir), "athlete_id").withColumn("p", F.lit(180.0)).withColumn("top", F.lit(200.0)).withColumn("f", S.intensity_factor("p", "ftp"))
    out = rows.select("activity_id", F.col("f").alias("intensity"), S.stress_score("total_timer_s", "p", "f", "ftp").alias("tss"), S.trimp("total_timer_s", "avg_hr", "resting_hr", "top", "sex").alias("trimp"), S.hr_tss("total_timer_s", "avg_hr", "resting_hr", "top").alias("hr_tss"))
    return rounded(out, "intensity", "tss", "trimp", "hr_tss")


SUGGEST = f"""{A.with_ctes('activities', 'athletes')}, o AS (SELECT athlete_id, max(max_hr) AS observed_max FROM activities GROUP BY athlete_id
), m AS (SELECT t.*, o.observed_max, CASE WHEN coalesce(o.observed_max, 0) >= 100 THEN greatest(base, floor(o.observed_max + 0.5)) ELSE base END AS top
  FROM (SELECT *, floor(CASE sex WHEN 'male' THEN 220 WHEN 'female' THEN 226 ELSE 223 END - age + 0.5) AS base FROM athletes) t LEFT JOIN o USING (athlete_id)
), z1 AS (SELECT *, floor(resting_hr + greatest(1, top - resting_hr) * 0.6 + 0.5) AS zone2 FROM m
), z2 AS (SELECT *, greatest(floor(resting_hr + greatest(1, top - resting_hr) * 0.7 + 0.5), zone2 + 1) AS zone3 FROM z1
), z3 AS (SELECT *, greatest(floor(resting_hr + greatest(1, top - resting_hr) * 0.8 + 0.5), zone3 + 1) AS zone4 FROM z2
), z4 AS (SELECT *, least(greatest(floor(resting_hr + greatest(1, top - resting_hr) * 0.9 + 0.5), zone4 + 1), top) AS zone5 FROM z3)"""


@query(f"{SUGGEST} SELECT athlete_id, observed_max, top AS max_hr, zone2, zone3, zone4, zone5 FROM z4")
def h12_a18_hr_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed top rates and the automatic profile of every athlete."""
    rows = A.athletes(spark, sf_dir).join(heart.observed_max_hr(A.activities(spark, sf_dir)), "athlete_id", "left")
    return rows.withColumn("p", S.auto_hr_profile("sex", "age", "resting_hr", "observed_max")).select("athlete_id", "observed_max", "p.*")


#: Riders of ids divisible by 3 are taken as having no power meter.
METERLESS = "athlete_id % 3 = 0"
CURVE = Q.GRADED.replace(f"{Q.R}", f"""{A.with_ctes('activities', 'athletes')}, own AS (SELECT a.activity_id, a.athlete_id, coalesce(a.rider_mass_kg, t.rider_mass_kg) + coalesce(a.bike_mass_kg, t.bike_mass_kg) AS kg FROM activities a JOIN athletes t USING (athlete_id)
), samples AS (SELECT r.* REPLACE (CASE WHEN NOT coalesce({METERLESS}, false) THEN r.power END AS power), o.kg, o.athlete_id FROM ({A.RECORDS_SQL}) r LEFT JOIN own o USING (activity_id)
), cover AS (SELECT athlete_id, count(DISTINCT o.activity_id) AS n_activities, count(s.activity_id) AS n_records, count(*) FILTER (WHERE power >= 0) AS n_power, count(*) FILTER (WHERE power >= 0 AND elapsed_s IS NOT NULL) AS n_timed, max(heart_rate) AS record_max
  FROM own o LEFT JOIN (SELECT * EXCLUDE (athlete_id) FROM samples) s USING (activity_id) GROUP BY athlete_id
), records AS (SELECT s.* FROM samples s JOIN cover c USING (athlete_id) WHERE c.n_timed = 0 AND record_index % 5 = 0)""", 1) + f"""
, pooled AS (SELECT activity_id, record_index, elapsed_ms, power FROM samples JOIN cover USING (athlete_id) WHERE n_timed > 0
  UNION ALL
  SELECT activity_id, record_index, elapsed_ms, least(1200, greatest(0, kg * 9.80665 * sin(atan(grade)) * step_ms + kg * 9.80665 * 0.004 * cos(atan(grade)) * step_ms + 0.5 * 1.225 * 0.25 * step_ms * step_ms * step_ms) / 0.97) FROM graded
  WHERE dt > 0 AND dt <= 5 AND step_ms >= 0.5 AND abs(grade) <= 0.18)""" + Q.mmp_sql()[len(Q.R):].replace("FROM records", "FROM pooled")
_LISTED = " || ".join(f"coalesce('{n}=' || CAST(round({n}, 1) AS VARCHAR) || ',', '')" for n in ("cp_derived", "mmp_60min", "mmp_close_to_60min", "p20"))


@query(f"""{CURVE}, best AS (SELECT athlete_id, duration_s, max(power) AS power FROM mmp JOIN own USING (activity_id) GROUP BY ALL
), fit AS (SELECT athlete_id, count(*) FILTER (WHERE power > 0) AS n, regr_slope(power, 1.0 / duration_s) FILTER (WHERE power > 0) AS s, regr_intercept(power, 1.0 / duration_s) FILTER (WHERE power > 0) AS i,
    CASE WHEN var_pop(power) FILTER (WHERE power > 0) = 0 THEN 0 ELSE regr_r2(power, 1.0 / duration_s) FILTER (WHERE power > 0) END AS r,
    string_agg(CAST(duration_s AS VARCHAR) || ':' || CAST(round(power, 3) AS VARCHAR), ' ' ORDER BY duration_s) AS curve FROM best GROUP BY athlete_id
), cand AS (SELECT athlete_id, curve, CASE WHEN n >= 3 AND i > 0 AND s >= 0 AND r >= 0.85 THEN i * 0.97 END AS cp_derived, NULL::DOUBLE AS mmp_60min, NULL::DOUBLE AS mmp_close_to_60min, NULL::DOUBLE AS p20 FROM fit
), o AS (SELECT athlete_id, max(max_hr) AS session_max FROM activities GROUP BY athlete_id
), m AS (SELECT t.*, greatest(o.session_max, c.record_max) AS observed_max, floor(CASE sex WHEN 'male' THEN 220 WHEN 'female' THEN 226 ELSE 223 END - age + 0.5) AS base, coalesce(n_activities, 0) AS n_activities, coalesce(n_records, 0) AS n_records, coalesce(n_power, 0) AS n_power, coalesce(n_timed, 0) AS n_timed
  FROM athletes t LEFT JOIN o USING (athlete_id) LEFT JOIN cover c USING (athlete_id)
), tops AS (SELECT *, CASE WHEN coalesce(observed_max, 0) >= 100 THEN greatest(base, floor(observed_max + 0.5)) ELSE base END AS max_hr FROM m
), z1 AS (SELECT *, floor(resting_hr + greatest(1, max_hr - resting_hr) * 0.6 + 0.5) AS zone2 FROM tops
), z2 AS (SELECT *, greatest(floor(resting_hr + greatest(1, max_hr - resting_hr) * 0.7 + 0.5), zone2 + 1) AS zone3 FROM z1
), z3 AS (SELECT *, greatest(floor(resting_hr + greatest(1, max_hr - resting_hr) * 0.8 + 0.5), zone3 + 1) AS zone4 FROM z2
), z4 AS (SELECT *, least(greatest(floor(resting_hr + greatest(1, max_hr - resting_hr) * 0.9 + 0.5), zone4 + 1), max_hr) AS zone5 FROM z3)
SELECT athlete_id, observed_max, max_hr, zone2, zone3, zone4, zone5, CASE WHEN cp_derived BETWEEN 80 AND 500 THEN floor(cp_derived + 0.5) ELSE 0 END AS ftp_auto, coalesce(rtrim({_LISTED}, ','), '') AS candidates,
  coalesce(curve, '5:0.0 10:0.0 20:0.0 30:0.0 60:0.0') AS curve, n_activities, n_records, n_power, n_timed, CASE WHEN n_timed > 0 THEN 'measured' WHEN curve IS NOT NULL THEN 'estimated' ELSE 'unavailable' END AS power_source
FROM z4 LEFT JOIN cand USING (athlete_id)""")
def a24_athlete_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile, curve and threshold-power candidates of every athlete, those without a power meter by estimates."""
    activities, athletes, records = A.activities(spark, sf_dir), A.athletes(spark, sf_dir), A.records(spark, sf_dir)
    meterless = activities.where(METERLESS).select("activity_id", F.lit(True).alias("_none"))
    records = records.join(meterless, "activity_id", "left").withColumn("power", F.when(F.col("_none").isNull(), F.col("power"))).drop("_none")
    rows = suggestion.athlete_suggestion(records, activities, athletes, durations=Q.SHORT)
    names = ("cp_derived", "mmp_60min", "mmp_close_to_60min", "p20")
    listed = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{n}="), F.round(n, 1).cast("string")) for n in names])), ",")
    curve = F.array_join(F.transform("curve", lambda x: F.concat(x["duration_s"].cast("string"), F.lit(":"), x["power"].cast("string"))), " ")
    return rows.withColumns({"candidates": listed, "curve": curve}).drop(*names)


@query(f"""{ACT}, s AS (SELECT *, CASE activity_id % 4 WHEN 0 THEN 'climb' WHEN 1 THEN 'flat' WHEN 2 THEN 'descent' ELSE 'stopped' END AS kind, activity_id % 5 = 0 AS technical, activity_id % 3 <> 0 AS has_power, activity_id % 7 <> 0 AS has_hr,
  activity_id % 9 * 1.0 AS grade, CASE WHEN activity_id % 2 = 0 THEN 'measured' ELSE 'estimated' END AS src FROM activities)
SELECT activity_id, CASE WHEN kind = 'stopped' THEN 'none' WHEN activity_id % 3 = 2 THEN CASE WHEN has_hr THEN 'hr' ELSE 'none' END WHEN technical THEN 'none' WHEN src = 'measured' AND has_power THEN 'power'
  WHEN kind = 'climb' AND has_power AND grade >= 3 THEN 'vpower' WHEN has_hr THEN 'hr' WHEN has_power THEN 'vpower' ELSE 'none' END AS basis FROM s""")
def h15_effort_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("activity_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("climb", "flat", "descent", "stopped")]), F.pmod(i, F.lit(4)).cast("int") + 1)
    rows = A.activities(spark, sf_dir).select("activity_id", "sport", kind.alias("kind"), (i % 5 == 0).alias("technical"), (i % 3 != 0).alias("has_power"), (i % 7 != 0).alias("has_hr"), (i % 9 * 1.0).alias("grade"), F.when(i % 2 == 0, "measured").otherwise("estimated").alias("src"))
    return rows.select("activity_id", S.effort_signal("sport", "kind", "technical", "has_power", "has_hr", "grade", "src").alias("e")).select("activity_id", "e.basis")


@query(f"""{ACT} SELECT activity_id, concat_ws(chr(10), '- Distance: ' || printf('%.1f', total_distance_km) || ' km', CASE WHEN avg_speed_kmh > 0 THEN '- Speed: ' || printf('%.1f', avg_speed_kmh) || ' km/h' END, CASE WHEN total_ascent_m > 0 THEN '- Ascent: ' || printf('%.0f', total_ascent_m) || ' m' END) AS fields,
  concat_ws(' · ', coalesce(strftime(coalesce(start_ts, CASE WHEN activity_id % 2 = 0 THEN make_timestamp(2021, 2, 3, activity_id % 24, 15, 30) END), '%d/%m/%Y, %H:%M'), CAST(activity_id AS VARCHAR) || '.fit'), sport,
    CASE WHEN total_distance_km > 0 THEN printf('%.1f', total_distance_km) || ' km' END, CASE WHEN total_timer_s > 0 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END) AS label
FROM (SELECT *, CAST(floor(total_timer_s + 0.5) AS BIGINT) AS s FROM activities) t""")
def h17_t8_fields_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("Distance", S.format_positive("total_distance_km", 1), "km"), ("Speed", S.format_positive("avg_speed_kmh", 1), "km/h"), ("Ascent", S.format_positive("total_ascent_m", 0), "m")]
    i = F.col("activity_id")
    dated = F.concat(F.lit("ride-20210203"), F.lpad((i % 24).cast("string"), 2, "0"), F.lit("1530.fit"))
    name = F.when(i % 2 == 0, dated).otherwise(F.concat(i.cast("string"), F.lit(".fit")))
    start = S.parse_activity_time(F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss"), name)
    label = X.activity_label(start, name, "sport", "total_distance_km", "total_timer_s")
    return A.activities(spark, sf_dir).select("activity_id", X.fields_skipping_empty(fields).alias("fields"), label.alias("label"))


@query("""WITH m AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''
), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM m)
SELECT c.conv_id AS activity_id, count(r.n) FILTER (WHERE r.n <= 24) AS n_kept, count(r.n) FILTER (WHERE r.role = 'user') AS n_user,
  coalesce(string_agg(CASE WHEN r.role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || r.text, chr(10) ORDER BY r.turn, r.role, r.text) FILTER (WHERE r.n <= 8), '') AS tail
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id""")
def h18_h21_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = A.chats(spark, sf_dir)
    return chats.select("activity_id", F.size(X.chat_clean("chat_json")).cast("long").alias("n_kept"), X.chat_user_count("chat_json").cast("long").alias("n_user"), X.chat_tail_lines("chat_json").alias("tail"))


@query("""SELECT conv_id AS activity_id, least(24, count(*) FILTER (WHERE role IN ('user', 'assistant') AND trim(text) <> '') + 1) AS n FROM conversations GROUP BY conv_id""")
def h19_chat_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = X.chat_append(X.chat_clean("chat_json"), F.lit("user"), F.lit(" and now? "))
    return A.chats(spark, sf_dir).select("activity_id", F.size(added).cast("long").alias("n"))


@query("""WITH p AS (SELECT doc_id AS activity_id, 'Intro' || chr(10) || '**Summary:** ' || lang || chr(10) || text || chr(10) || '**Advice** rest' AS t FROM documents
), b AS (SELECT activity_id, t, string_split(regexp_replace(coalesce(t, ''), '(?m)^(\\*\\*[^\\n]+?\\*\\*)', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM p)
SELECT activity_id, coalesce(array_to_string(list_transform(list_filter(parts, lambda x: length(x) > 0), lambda x: CASE WHEN regexp_matches(x, '^\\*\\*[^\\n]+?\\*\\*')
  THEN regexp_replace(regexp_extract(x, '^\\*\\*([^\\n]+?)\\*\\*', 1), ':$', '') ELSE 'Preamble' END || ':' || CAST(length(x) AS VARCHAR)), ','), '') AS blocks, CAST(length(t) AS BIGINT) AS total FROM b""")
def h22_prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    text = F.concat(F.lit("Intro\n**Summary:** "), "lang", F.lit("\n"), "text", F.lit("\n**Advice** rest"))
    rows = docs.select(F.col("doc_id").alias("activity_id"), text.alias("t")).withColumn("b", X.prompt_blocks("t"))
    listed = F.array_join(F.transform("b", lambda x: F.concat(x["title"], F.lit(":"), x["chars"].cast("string"))), ",")
    return rows.select("activity_id", listed.alias("blocks"), F.length("t").cast("long").alias("total"))


@query(f"""{ACT}, u AS (SELECT activity_id, 0::DOUBLE AS lo, total_distance_km AS hi, total_distance_km / 5 AS raw FROM activities
), p AS (SELECT *, pow(10, floor(log10(raw))) AS pw FROM u), s AS (SELECT *, pw * CASE WHEN raw / pw <= 1 THEN 1 WHEN raw / pw <= 2 THEN 2 WHEN raw / pw <= 5 THEN 5 ELSE 10 END AS step FROM p)
SELECT activity_id, CAST(floor(hi / step) AS BIGINT) + 1 AS n_ticks, round(floor(hi / step) * step, 6) AS last_tick FROM s""")
def h23_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.activities(spark, sf_dir).withColumn("zero", F.lit(0.0)).withColumn("t", S.nice_ticks("zero", "total_distance_km"))
    return rounded(rows.select("activity_id", F.size("t").cast("long").alias("n_ticks"), F.element_at("t", -1).alias("last_tick")), "last_tick")


@query(f"""{ACT}, u AS (SELECT activity_id, total_distance_km AS hi, CASE WHEN total_distance_km / 0.5 > 60 THEN ceil(total_distance_km / 60) ELSE 0.5 END AS step FROM activities)
SELECT activity_id, CASE WHEN hi > 0 THEN CAST(floor(hi / step) AS BIGINT) + 1 ELSE 0 END AS n_markers, round(CASE WHEN hi > 0 THEN floor(hi / step) * step END, 6) AS last_km FROM u""")
def h23_distance_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks every half kilometre of a ride, or every few kilometres of a long one."""
    rows = A.activities(spark, sf_dir).withColumn("m", S.distance_markers(F.lit(0.0), "total_distance_km", F.lit(0.5)))
    return rounded(rows.select("activity_id", F.size("m").cast("long").alias("n_markers"), F.try_element_at("m", F.lit(-1)).alias("last_km")), "last_km")


@query("""SELECT vec_id AS id, CASE WHEN abs(v) >= 1000 THEN printf('%.0f', v) WHEN abs(v) >= 100 THEN printf('%.1f', v) WHEN abs(v) >= 10 THEN printf('%.2f', v) ELSE printf('%.3f', v) END AS t
FROM (SELECT vec_id, CAST(vec_id % 6007 AS DOUBLE) * CASE WHEN vec_id % 2 = 0 THEN 1 ELSE -1 END / 3 AS v FROM embeddings) e""")
def h5_format_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirds of all ids, so that no digit is halfway and both engines print alike."""
    v = (F.col("vec_id") % 6007).cast("double") * F.when(F.col("vec_id") % 2 == 0, 1).otherwise(-1) / 3
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), S.format_number(v).alias("t"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    activities, analyses = A.activities(spark, sf_dir), A.analyses(spark, sf_dir)
    recent = history.recent_analyses(activities, analyses).select("activity_id", "other_id", F.col("other_start_s").alias("start_s"))
    other = activities.select(F.col("activity_id").alias("other_id"), F.col("total_distance_km").alias("distance_km"), F.col("total_timer_s").alias("duration_s"))
    texts = analyses.select(F.col("activity_id").alias("other_id"), "analysis_text")
    counts = A.chats(spark, sf_dir).select(F.col("activity_id").alias("other_id"), X.chat_user_count("chat_json").alias("chat_count"))
    return recent.join(other, "other_id").join(texts, "other_id").join(counts, "other_id", "left")


HISTORY = f"""{RECENT}, talks AS (SELECT conv_id AS other_id, count(*) FILTER (WHERE role = 'user') AS n FROM conversations GROUP BY conv_id
), entries AS (SELECT r.activity_id, r.other_start_s AS s, r.other_id, strftime(make_timestamp(r.other_start_s * 1000000), '%Y-%m-%d') AS day, n.analysis_text, t.n AS asked,
    printf('%.1f', o.total_distance_km) || ' km, ' || {HMS.format(s='CAST(floor(o.total_timer_s + 0.5) AS BIGINT)')} AS brief, row_number() OVER (PARTITION BY r.activity_id ORDER BY r.other_start_s DESC, r.other_id DESC) AS newest
  FROM recent r JOIN activities o ON o.activity_id = r.other_id JOIN analyses n ON n.activity_id = r.other_id LEFT JOIN talks t ON t.other_id = r.other_id
), history AS (SELECT activity_id, '**Recent Activity History (earlier workouts, oldest first):**' || chr(10) || string_agg(CASE WHEN newest > 4 THEN day || ': ' || brief
    ELSE day || ' (' || brief || '):' || chr(10) || trim(coalesce(analysis_text, '')) || CASE WHEN asked > 0 THEN chr(10) || '  (follow-up chat: ' || CAST(asked AS VARCHAR) || ' questions)' ELSE '' END END, chr(10) || chr(10) ORDER BY s, other_id) AS text
  FROM entries GROUP BY activity_id)"""


@query(f"{HISTORY} SELECT activity_id, text FROM history")
def t4_recent_history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.recent_history_text(_entries(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame | None], DataFrame, DataFrame]:
    """The text blocks of all dated activities, in order (the history is made from the others), the progress that tells which those are, and the rides."""
    activities, analyses = A.activities(spark, sf_dir), A.analyses(spark, sf_dir)
    progress = history.progress_summary(activities)
    measures = activities.select("activity_id", X.fields_skipping_empty([("Distance", S.format_positive("total_distance_km", 1), "km"), ("Duration", S.format_hms("total_timer_s"), None), ("Average HR", S.format_positive(history.effective_hr(), 0), "bpm")]).alias("text"))
    baseline = progress.select("activity_id", X.fields_skipping_empty([("Earlier rides", F.nullif("n_prior", F.lit(0)), None), ("Speed trend", F.col("trend_speed"), None), ("HR trend", F.col("trend_hr"), None)]).alias("text"))
    last = analyses.select("activity_id", F.col("analysis_text").alias("text"))
    chat = A.chats(spark, sf_dir).select("activity_id", X.chat_tail_lines("chat_json").alias("text"), X.chat_user_count("chat_json").alias("chat_count"))
    # entries without their texts, for the lines of older ones
    ids = analyses.select(F.col("activity_id").alias("other_id"))
    told = activities.select(F.col("activity_id").alias("other_id"), F.col("total_distance_km").alias("distance_km"), F.col("total_timer_s").alias("duration_s")).join(ids, "other_id")
    entries = history.recent_analyses(activities, analyses).withColumnRenamed("other_start_s", "start_s").join(told, "other_id")
    dated = activities.where("start_s IS NOT NULL").select("athlete_id", "activity_id", "start_s", history.midnight_before().alias("since"), F.col("total_distance_km").alias("distance_km"), F.col("total_timer_s").alias("duration_s"))
    rides = dated.join(summary.older_history_lines(entries), "activity_id", "left")
    return {"measures": measures, "baseline": baseline, "history": None, "analysis": last, "chat": chat}, progress, rides


@query(f"""{HISTORY}, progress AS ({ORACLE_SQL['j5_a22_progress_summary']}
), said AS (SELECT conv_id AS activity_id, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS newest
  FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''
), chat AS (SELECT activity_id, string_agg(line, chr(10) ORDER BY newest DESC) AS text FROM said WHERE newest <= 8 GROUP BY activity_id
), measures AS (SELECT activity_id, concat_ws(chr(10), CASE WHEN total_distance_km > 0 THEN '- Distance: ' || printf('%.1f', total_distance_km) || ' km' END, '- Duration: ' || {HMS.format(s='CAST(floor(total_timer_s + 0.5) AS BIGINT)')},
    CASE WHEN coalesce(manual_avg_hr, avg_hr) > 0 THEN '- Average HR: ' || printf('%.0f', coalesce(manual_avg_hr, avg_hr)) || ' bpm' END) AS text FROM activities)
SELECT p.activity_id, concat_ws(chr(10) || chr(10), m.text, concat_ws(chr(10), '- Earlier rides: ' || CAST(nullif(p.n_prior, 0) AS VARCHAR), '- Speed trend: ' || p.trend_speed, '- HR trend: ' || p.trend_hr), h.text, n.analysis_text, c.text) AS document,
  p.n_prior AS prior_activity_count, p.n_prior >= 3 AS has_trend_evidence
FROM progress p LEFT JOIN measures m USING (activity_id) LEFT JOIN history h USING (activity_id) LEFT JOIN analyses n USING (activity_id) LEFT JOIN chat c USING (activity_id)""")
def t7_context_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for a model of all dated activities: measures, progress, history, last analysis, chat."""
    return summary.context_document(*_blocks(spark, sf_dir))


@query()
def t7_ride_context_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with the rider's profile, the time in zones and the segments of rides that have records."""
    parts, progress, rides = _blocks(spark, sf_dir)
    activities, records = A.activities(spark, sf_dir), bucketed(A.records(spark, sf_dir), "ride_records", "activity_id", placed=True)
    riders = activities.select("activity_id", "athlete_id", "sport", F.col("rider_mass_kg").alias("_own")).join(A.athletes(spark, sf_dir), "athlete_id").withColumn("rider_mass_kg", F.coalesce("_own", "rider_mass_kg"))
    found = heart.hr_profile_as_of(activities, A.hr_profiles(spark, sf_dir)).select("activity_id", "profile.*")
    own = F.array_compact(F.array(*[F.col(f"zone{i}").cast("double") for i in range(2, 6)]))
    limits = found.where("max_hr IS NOT NULL").select("activity_id", F.col("max_hr").cast("double").alias("top_hr"), own.alias("_own"))
    limits = limits.select("activity_id", "top_hr", S.zone_thresholds("top_hr", F.col("_own")).alias("thresholds"))
    recorded = limits.join(records.select("activity_id").distinct(), "activity_id", "left_semi")
    context = riders.select("activity_id", "sport", "ftp", F.col("resting_hr").alias("rest_hr"), "sex").join(limits.select("activity_id", "top_hr"), "activity_id", "left").withColumn("power_source", F.lit("measured"))
    built = materialize(segments.build_segments(records, context, min_seconds=20.0, drift_s=40.0, least=2.0), "segments")
    blocks = {
        "profile": summary.profile_text(riders.join(limits.select("activity_id", "top_hr"), "activity_id", "left")),
        "zones": summary.zone_context(heart.hr_zone_time(records, recorded), recorded), "segments": summary.segment_context(built),
    }
    order = ("measures", "baseline", "profile", "zones", "history", "segments", "analysis", "chat")
    return summary.context_document({n: (parts | blocks)[n] for n in order}, progress, rides)
