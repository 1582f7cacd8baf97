"""Ride operators against known values and plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velotrace.functions import scalars as S
from velotrace.functions import text as X
from velotrace.operators import clean, heart, history, kernels, maintain, power, segments, series, summary

COLUMNS = "activity_id long, record_index long, elapsed_ms long, elapsed_s double, distance_km double, speed_kmh double, heart_rate double, altitude_m double, position_lat double, position_long double, cadence double, power double, temperature double"


def ride(spark, n=0, activity=1, t=None, **c):
    """Records of one activity; each channel is a function of the index or missing."""
    rows = []
    for i in range(n):
        sec = float(t(i)) if t else float(i)
        get = lambda k: None if c.get(k) is None or c[k](i) is None else float(c[k](i))  # noqa: B023, E731
        rows.append((activity, i, int(sec * 1000), sec, *[get(k) for k in ("distance", "speed", "hr", "alt", "lat", "lon", "cadence", "power", "temperature")]))
    return spark.createDataFrame(rows, COLUMNS)


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def terrain_ride(spark, profile, kmh=18.0, power_of=None, hr=140.0):
    """1 Hz due east with a grade profile of (percent, seconds)."""
    step, alt, km, grades = kmh / 3600, 100.0, 0.0, [g for g, s in profile for _ in range(s)]
    alts, kms = [], []
    for g in grades:
        km, alt = km + step, alt + step * 1000 * g / 100
        alts.append(alt)
        kms.append(km)
    return ride(spark, len(grades), distance=lambda i: kms[i], speed=lambda i: kmh, hr=lambda i: hr, alt=lambda i: alts[i], lat=lambda i: 52.0, lon=lambda i: 21 + kms[i] / 68.5, power=power_of)


def test_power_identities(spark):
    steady = ride(spark, 180, power=lambda i: 240)
    assert power.normalized_power(steady).first()["np"] == pytest.approx(240)
    assert power.x_power(steady).first()["xpower"] == pytest.approx(240)
    row = spark.range(1).select(S.stress_score(F.lit(3600.0), F.lit(250.0), F.lit(250 / 300), F.lit(300.0)).alias("tss"), S.stress_score(F.lit(3600.0), F.lit(240.0), F.lit(0.8), F.lit(300.0)).alias("bike")).first()
    assert row["tss"] == pytest.approx(69.4444, abs=1e-4) and row["bike"] == pytest.approx(64)


def test_mmp_and_auto_ftp(spark):
    steps = ride(spark, 121, power=lambda i: 200 if 30 <= i < 91 else 100)
    curve = {r["duration_s"]: r["power"] for r in power.mmp_curve(steps, (60, 300)).collect()}
    assert curve == {60: 200, 300: 0}
    assert power.auto_ftp(ride(spark, 1260, power=lambda i: 250)).first()["ftp"] == 238
    assert power.auto_ftp(ride(spark, 600, power=lambda i: 250)).first()["ftp"] == 0


def test_critical_power(spark):
    curve = spark.createDataFrame([(1, d, 250 + 10000 / d) for d in (60, 300, 1200, 3000)], "athlete_id long, duration_s int, power double")
    fit = power.ftp_candidates(curve, "athlete_id").withColumn("ftp", power.select_ftp("cp_derived")).first()
    assert fit["cp"] == pytest.approx(250) and fit["w_prime"] == pytest.approx(10000) and fit["ftp"] in (242, 243)


def test_stops(spark):
    # 25 rows at 0 km/h from row 20 on, and a gap before row 50
    rides = ride(spark, 60, t=lambda i: i if i < 50 else i + 350, speed=lambda i: 0 if 20 <= i < 45 else 25)
    got = [(r["start_index"], r["end_index"], r["duration_s"]) for r in series.detect_stops(rides).orderBy("start_index").collect()]
    assert got == [(20, 44, 24.0), (49, 50, 351.0)]


def test_terrain(spark):
    climb = terrain_ride(spark, [(0, 90), (6, 120), (0, 90), (-6, 120)])
    kinds = [r["terrain"] for r in segments.macro_segments(climb).orderBy("start_index").collect()]
    assert kinds == ["flat", "climb", "flat", "descent"]
    with pytest.raises(ValueError):
        series.terrain_state(climb, 1.0, 2.0)


def test_terrain_state_equals_the_machine(spark):
    rng = random.Random(3)
    rows = [(a, i, rng.choice([None, -4.0, -2.7, -2.2, 0.0, 2.2, 2.7, 4.0, 3.0, 2.0]), rng.random() < 0.1) for a in range(30) for i in range(60)]
    df = spark.createDataFrame(rows, "activity_id long, record_index long, grade_pct double, stopped boolean")
    got = {(r["activity_id"], r["record_index"]): r["terrain"] for r in series.terrain_state(df).collect()}
    for a in range(30):
        state = "flat"
        for _, i, g, stopped in (r for r in rows if r[0] == a):
            if stopped:
                assert got[a, i] == "stopped"
                continue
            if g is not None:
                if state == "climb":
                    state = "climb" if g >= 2.0 else ("descent" if g < -3.0 else "flat")
                elif state == "descent":
                    state = "descent" if g <= -2.0 else ("climb" if g > 3.0 else "flat")
                else:
                    state = "climb" if g > 3.0 else "descent" if g < -3.0 else "flat"
            assert got[a, i] == state


def test_gps_and_trust(spark):
    straight = ride(spark, 400, distance=lambda i: 1.05 * i * 30 / 3600, speed=lambda i: 30, alt=lambda i: 100, lat=lambda i: 52.0, lon=lambda i: 21 + i * 30 / 3600 / (111.19493 * math.cos(math.radians(52))))
    speeds = [r["gps_kmh"] for r in clean.gps_speed(straight).orderBy("record_index").collect()]
    assert all(abs(v - 30) < 1 for v in speeds[5:])
    ratio = segments.wheel_ratio(segments.trusted_speed_windows(straight)).first()
    assert ratio["ratio"] == pytest.approx(1.05, abs=0.01)
    row = spark.range(1).select(S.haversine_km(F.lit(52.0), F.lit(21.0), F.lit(53.0), F.lit(21.0)).alias("km"), S.normalize_coordinate(F.lit(52 * 2.0**31 / 180), 90).alias("lat")).first()
    assert row["km"] == pytest.approx(111.19, abs=0.01) and row["lat"] == pytest.approx(52)


def test_zones(spark):
    rates = [100, 110, 120, 140, 160, 180]
    rides = ride(spark, 6, hr=lambda i: rates[i])
    limits = spark.createDataFrame([(1, 190.0, [120.0, 140.0, 160.0, 175.0])], "activity_id long, top_hr double, thresholds array<double>")
    got = [r["seconds"] for r in heart.hr_zone_time(rides, limits).orderBy("zone").collect()]
    assert got == [2, 1, 1, 1, 1]
    assert "Zone 1 (95-119 bpm): 00:00:02 (33%)" in summary.zone_context(heart.hr_zone_time(rides, limits), limits).first()["text"]
    p = spark.createDataFrame([("male", 40.0, 55.0, 186.0)], "sex string, age double, rest double, seen double").select(S.auto_hr_profile("sex", "age", "rest", "seen").alias("p")).first()["p"]
    assert tuple(p) == (186, 134, 147, 160, 173)


def test_kernels():
    assert kernels.bottom_up([200 + (4 if i % 2 else -4) for i in range(40)]) == [(0, 39)]
    assert kernels.bottom_up([150.0] * 20 + [300.0] * 20) == [(0, 19), (20, 39)]
    assert kernels.despike(np.array([10.0, 10, 90, 10, 10]), 12, 0.5).tolist() == [10, 10, 10, 10, 10]
    t = np.arange(1800.0)
    assert kernels.decoupling(t, np.full(1800, 200.0), np.full(1800, 140.0), 250, 50, 190) == pytest.approx(0, abs=0.01)
    assert kernels.decoupling(t, np.full(1800, 200.0), np.where(t < 900, 135.0, 150.0), 250, 50, 190) > 5
    rest, work = dict(type="flat", effort_basis="power", duration_s=60, avg_power=100, avg_hr=None), dict(type="flat", effort_basis="power", duration_s=60, avg_power=300, avg_hr=None)
    assert kernels.group_similar([work, rest] * 3 + [work]) == [(0, 2, 3), (6, 1, 1)]
    assert kernels.group_similar([work] * 4 + [rest]) == [(0, 1, 4), (4, 1, 1)]


def test_segments_of_a_ride(spark):
    rides = terrain_ride(spark, [(0, 120), (6, 900), (-6, 120)], power_of=lambda i: 250 if 120 <= i < 1020 else 150)
    context = spark.createDataFrame([(1, "cycling", "measured", 250.0, 50.0, 190.0)], "activity_id long, sport string, power_source string, ftp double, rest_hr double, top_hr double")
    got = segments.build_segments(rides, context).orderBy("segment").collect()
    assert {r["effort_basis"] for r in got} == {"power"} and [r["segment"] for r in got] == list(range(len(got)))
    assert max(got, key=lambda r: r["duration_s"])["avg_power"] >= 245
    text = summary.segment_context(segments.build_segments(rides, context)).first()
    assert text["text"].startswith("1. 00:00:00-") and not text["exceeded"]


def test_history(spark):
    day = 86400
    acts = spark.createDataFrame(
        [(1, 7, 0 * day, 20.0), (2, 7, 3 * day, 22.0), (3, 7, 3 * day, 21.0), (4, 7, 60 * day, 90.0), (5, 7, None, 20.0)], "activity_id long, athlete_id long, start_s long, total_distance_km double"
    ).selectExpr("*", "3600D AS total_timer_s", "25D AS avg_speed_kmh", "50D AS max_speed_kmh", "140D AS avg_hr", "CAST(NULL AS DOUBLE) AS manual_avg_hr", "180D AS max_hr", "100D AS total_ascent_m", "1 AS imported_s")
    assert values(history.comparable_rides(acts).select("activity_id", "p_activity_id"), "activity_id", "p_activity_id") == [(2, 1), (3, 1), (3, 2)]
    got = {r["activity_id"]: (r["n_7"], r["km_7"]) for r in history.recent_totals(acts).collect()}
    assert got == {1: (0, 0), 2: (1, 20), 3: (2, 42), 4: (0, 0)}
    done = spark.createDataFrame([(1, 3), (2, 5)], "activity_id long, analysis_version int")
    assert values(history.recent_analyses(acts, done).select("activity_id", "other_id"), "activity_id", "other_id") == [(2, 1), (3, 1), (4, 2)]
    assert [r["activity_id"] for r in history.outdated_analyses(acts, done, 5).collect()] == [1, 3, 4, 5]
    profiles = spark.createDataFrame([(7, 2, 190), (7, 40, 193)], "athlete_id long, effective_day long, max_hr int")
    shown = {r["activity_id"]: r["profile"]["max_hr"] for r in heart.hr_profile_as_of(acts, profiles).collect()}
    assert shown == {1: 193, 2: 190, 3: 190, 4: 193, 5: 193}


def test_text(spark):
    one = spark.range(1)
    chat = '[{"role":"system","content":"x"},{"role":"user","content":"a"},{"role":"assistant","content":" "},{"role":"assistant","content":"b"}]'
    row = one.select(X.chat_tail_lines(F.lit(chat)).alias("t"), X.chat_user_count(F.lit(chat)).alias("n"), F.size(X.chat_clean(F.lit("no json"))).alias("bad"), X.prompt_blocks(F.lit("ab\n**Head:** c\n**Two**")).alias("b"), S.format_hms(F.lit(3661.4)).alias("h"), S.format_clock(F.lit(3661)).alias("c")).first()
    assert (row["t"], row["n"], row["bad"], row["h"], row["c"]) == ("User: a\nAssistant: b", 1, 0, "01:01:01", "61:01")
    assert [tuple(b) for b in row["b"]] == [("Preamble", 3), ("Head", 12), ("Two", 7)]


def test_mmp_against_all_windows(spark):
    rng = random.Random(5)
    times = [0]
    for _ in range(299):
        times.append(times[-1] + rng.choice([0, 1, 1, 1, 2, 9]) * 1000)
    watts = [float(rng.randrange(300)) if rng.random() > 0.1 else None for _ in times]
    rows = spark.createDataFrame([(1, i, t, w) for i, (t, w) in enumerate(zip(times, watts, strict=True))], "activity_id long, record_index long, elapsed_ms long, power double")
    known, durations, runs = [(t, w) for t, w in zip(times, watts, strict=True) if w is not None], (1, 2, 5, 10, 20), []
    for t, w in known:
        if not runs or t - runs[-1][-1][0] > 5000:
            runs.append([])
        runs[-1].append((t, w))
    want = dict.fromkeys(durations, 0.0)
    for d in durations:
        for run in runs:
            for t, _ in run:
                inside = [w for u, w in run if t <= u <= t + d * 1000]
                if max(u for u, _ in run if u <= t + d * 1000) - t >= d * 1000:
                    want[d] = max(want[d], sum(inside) / len(inside))
    got = {r["duration_s"]: r["power"] for r in power.mmp_curve(rows, durations).collect()}
    assert got == pytest.approx(want) and want[10] > 0


def test_max_speed_against_the_loop(spark):
    rng = random.Random(6)
    speeds = [rng.choice([20.0, 21.0, 22.0, 60.0, 5.0, None]) for _ in range(400)]
    want = kernels.despike(np.array([v for v in speeds if v is not None]), 12, 0.5).max()
    odd = ride(spark, 400, speed=lambda i: speeds[i])
    assert summary.max_despiked_speed(odd).first()["max_speed"] == pytest.approx(want)
    calm = ride(spark, 5, speed=lambda i: [10.0, 10.0, 90.0, 10.0, 10.0][i])
    assert summary.max_despiked_speed(calm).first()["max_speed"] == 10


def test_recordings_and_patches(spark):
    files = spark.createDataFrame([("a/x.FIT",), ("a/node_modules/y.fit",), (".git/z.fit",), ("a/b.txt",)], "path string")
    assert [r["path"] for r in maintain.recordings(files).collect()] == ["a/x.FIT"]
    log = spark.createDataFrame([(1, 1, 5.0, None), (1, 2, None, 6.0), (1, 3, 7.0, None)], "athlete_id long, at int, age double, ftp double")
    assert values(maintain.latest_patch(log, "athlete_id", "at"), "athlete_id") == [(1, 7.0, 6.0)]
    assert values(maintain.patch_log_rows(log, "athlete_id", "at"), "at") == [(1, 1, 5.0, None), (1, 2, 5.0, 6.0), (1, 3, 7.0, 6.0)]


def test_sessions_by_gap(spark, tmp_path):
    from velotrace.streaming import indexing

    source = f"file://{tmp_path}/samples"
    seconds = [0, 3, 6, 20, 22, 60]
    rows = spark.createDataFrame([(1, s, 100.0 + s) for s in seconds], "activity_id long, s long, power double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    rows.write.parquet(source)
    # a later sample moves the watermark past the runs
    rows.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1_700_001_000))).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    query = indexing.sessions_by_gap(stream).writeStream.format("memory").queryName("runs_by_gap").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").start()
    query.awaitTermination()
    got = spark.table("runs_by_gap").select(F.unix_timestamp("start_ts") - 1_700_000_000, "n", "avg_power")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 3, 103.0), (20, 2, 121.0), (60, 1, 160.0)]


def test_logs(spark, tmp_path):
    logs = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'a' AS m UNION ALL SELECT timestamp'2024-01-09 10:00:00', 'b'")
    maintain.write_logs(logs, f"file://{tmp_path}/logs")
    back = spark.read.json(f"file://{tmp_path}/logs")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert maintain.prune_logs(back.withColumn("ts", F.to_timestamp("ts")), 3, now).count() == 1 and maintain.prune_logs(back, 0, now).count() == 2


def test_incremental_indexing(spark, tmp_path):
    from velotrace.streaming import indexing

    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "table", "state"))
    cols = "activity_id long, file_path string, total_distance_km double, rider_mass_kg double, manual_avg_hr double, imported_s long"
    spark.createDataFrame([(1, "a", 10.0, None, None, 1), (1, "a", 11.0, 70.0, None, 2)], cols).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    indexing.index_available(spark, source, schema, target, state)
    spark.createDataFrame([(2, "b", 5.0, None, None, 3)], cols).write.mode("append").parquet(source)
    indexing.index_available(spark, source, schema, target, state)
    rows = values(indexing.latest_version(spark, target).select("file_path", "total_distance_km", "rider_mass_kg"), "file_path")
    assert rows == [("a", 11.0, 70.0), ("b", 5.0, None)]


def test_indexing_writes_touched_buckets_only(spark, tmp_path):
    from velotrace.streaming import indexing

    target = f"file://{tmp_path}/table"
    cols = "activity_id long, file_path string, total_distance_km double, rider_mass_kg double, manual_avg_hr double, imported_s long"
    batch = lambda rows: spark.createDataFrame([(i, p, km, None, None, at) for i, p, km, at in rows], cols)
    indexing.merge_batch(batch([(i, f"f{i}", 1.0, 0) for i in range(50)]), 0, target, 8)
    indexing.merge_batch(batch([(3, "f3", 2.0, 1)]), 1, target, 8)
    once = values(indexing.latest_version(spark, target).select("file_path", "total_distance_km"), "file_path")
    indexing.merge_batch(batch([(3, "f3", 2.0, 1)]), 1, target, 8)  # repeated after a failure
    again = values(indexing.latest_version(spark, target).select("file_path", "total_distance_km"), "file_path")
    assert once == again and len(once) == 50 and ("f3", 2.0) in once
    assert len(list((tmp_path / "table").glob("version=0000000001/bucket=*"))) == 1
    assert len(list((tmp_path / "table").glob("version=0000000000/bucket=*"))) == 8
    indexing.merge_batch(batch([(4, "new", 2.0, 1)]), 2, target, 8)
    assert indexing.latest_version(spark, target).count() == 51
    # a part that a finished batch has replaced is gone
    assert len(list((tmp_path / "table").glob("version=0000000000/bucket=*"))) == 7
    indexing.merge_batch(batch([]), 3, target, 8)
    assert indexing.latest_version(spark, target).count() == 51
