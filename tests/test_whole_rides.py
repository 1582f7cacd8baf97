"""Registered ride queries take all rows of long rides, checked on records of their own and against DuckDB."""

import math

import duckdb
import pytest
from test_rides import ride

from velotrace import jobs
from velotrace.operators import summary
from velotrace.sources import adapters as A


@pytest.fixture
def long_ride(spark, monkeypatch):
    """A ride of 7,000 fixes that zigzags, in place of the tables."""
    lat, lon = (lambda i: 52 + i % 2 * 0.001), (lambda i: 21 + i * 0.0001 + (0.5 if i == 6998 else 0))
    rows = ride(spark, 7000, lat=lat, lon=lon, distance=lambda i: i * 0.01, speed=lambda i: 20 + i % 7, hr=lambda i: 120, alt=lambda i: i % 50)
    monkeypatch.setattr(A, "records", lambda *_: rows)
    return lat, lon


def test_route_stats_of_all_fixes(spark, long_ride):
    lat, lon = long_ride
    km = 0.0
    for i in range(1, 7000):
        la, lb, d = math.radians(lat(i - 1)), math.radians(lat(i)), math.radians(lon(i) - lon(i - 1))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2
        km += 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))
    got = jobs.QUERIES["a12_h1_route_stats"](spark, "").first()
    assert got["n_points"] == 7000 and got["path_km"] == pytest.approx(km, abs=1e-5) and got["east"] == pytest.approx(lon(6998))


def test_overlay_keeps_all_points(spark, long_ride):
    got = jobs.QUERIES["t5_overlay_metrics"](spark, "")
    assert {r["channel"]: r["count"] for r in got.groupBy("channel").count().collect()} == {"speed_kmh": 7000, "altitude_m": 7000}


NEXT_SQL = "SELECT * FROM (SELECT user_id AS l, lead(user_id) OVER (ORDER BY user_id) AS r FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) t) p WHERE r IS NOT NULL"


def test_compare_pairs_each_with_the_next(spark):
    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(NEXT_SQL.replace("events", f"read_parquet('{sf}/events.parquet')")).fetchall()
    got = jobs.QUERIES["j9_compare_activities"](spark, sf).groupBy("left_id", "right_id").count().collect()
    assert len(want) > 10 and sorted((r["left_id"], r["right_id"]) for r in got) == sorted(want) and len({r["count"] for r in got}) == 1


def test_next_activities_over_many_ranges(spark):
    kept = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        ids = [i * i for i in range(200)] + [4, None]
        pairs = summary.next_activities(spark.createDataFrame([(i,) for i in ids], "activity_id long")).collect()
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)
    assert sorted((r["left_id"], r["right_id"]) for r in pairs) == [(i * i, (i + 1) ** 2) for i in range(199)]
    assert summary.next_activities(spark.createDataFrame([], "activity_id long")).count() == 0


def test_trusted_speed_rejects_jumps_and_wrong_wheels(spark, monkeypatch):
    """Steady rides count; a jump of the fixes or a wheel speed 30 % off does not."""
    step = 10 / 1000 / (6371 * math.pi / 180)
    good = lambda a, **c: ride(spark, 90, a, **({"lat": lambda i: 52 + i * step, "lon": lambda i: 21, "distance": lambda i: i * 0.0102, "speed": lambda i: 36} | c))
    rows = good(1).unionByName(good(2, lat=lambda i: 52 + i * step + i % 2 * 0.0005)).unionByName(good(3, speed=lambda i: 47))
    monkeypatch.setattr(A, "steady_records", lambda *_: rows)
    got = jobs.QUERIES["w17_w18_a13_trusted_speed"](spark, "").collect()
    assert [r["activity_id"] for r in got] == [1] and got[0]["n_high"] > 40


def test_enhanced_channels_and_labels(spark):
    """An enhanced speed of 0 fills nothing; a label falls back to the file name and tells hours."""
    from pyspark.sql import functions as F

    from velotrace.functions import scalars as S
    from velotrace.functions import text as X
    from velotrace.operators import clean

    rows = [(None, 0.0, None, 5.0), (None, 3.0, 1.0, 5.0), (0.0, 4.0, None, None), (0.0, 0.0, 2.0, None), (7.0, 9.0, None, 6.0)]
    df = spark.createDataFrame(rows, "speed_kmh double, enhanced_speed double, altitude_m double, enhanced_altitude double")
    got = [(r["speed_kmh"], r["altitude_m"]) for r in clean.enhanced_fallback(df).collect()]
    assert got == [(None, 5.0), (3.0, 1.0), (4.0, None), (0.0, 2.0), (7.0, 6.0)]
    rows = [("2024-05-06T07:08:09", "a.fit", 10.0, 3725.0), (None, "x20240102030405.fit", None, 59.4), (None, "b.fit", 0.0, None)]
    named = spark.createDataFrame(rows, "t string, f string, km double, s double")
    label = X.activity_label(S.parse_activity_time("t", F.col("f")), F.col("f"), F.lit("cycling"), F.col("km"), F.col("s"))
    assert [r[0] for r in named.select(label).collect()] == ["06/05/2024, 07:08 · cycling · 10.0 km · 01:02:05", "02/01/2024, 03:04 · cycling · 00:00:59", "b.fit · cycling"]


def test_near_sixty_minutes_only_without_sixty(spark):
    from velotrace.operators import power

    curve = [(a, d, 200.0 + 1000 / d) for a, ds in ((1, (1200, 3000, 3300, 3600)), (2, (1200, 3000, 3300))) for d in ds]
    got = {r["a"]: r for r in power.ftp_candidates(spark.createDataFrame(curve, "a int, duration_s int, power double"), "a").collect()}
    assert got[1]["mmp_60min"] and got[1]["mmp_close_to_60min"] is None
    assert got[2]["mmp_60min"] is None and got[2]["mmp_close_to_60min"] == pytest.approx(200 + 1000 / 3300)


def test_summary_without_a_profile_uses_its_own_maximum(spark):
    rows = ride(spark, 400, hr=lambda i: 120 + i // 8, distance=lambda i: i * 0.01, speed=lambda i: 30, alt=lambda i: 100).selectExpr("* EXCEPT (power)", "200D AS power")
    schema = "activity_id long, ftp double, rest_hr double, top_hr double, sex string"
    one, two = (summary.activity_summary(rows, spark.createDataFrame([(rows.first()["activity_id"], 220.0, 50.0, top, "male")], schema)).first() for top in (None, 120.0 + 399 // 8))
    assert one["decoupling_pct"] == two["decoupling_pct"] > 0 and one["trimp"] == two["trimp"]


def test_summary_prefers_what_the_device_says(spark):
    """Distance, time and speeds of the session go first; its heart rates only fill in."""
    rows = ride(spark, 100, distance=lambda i: i * 0.01, speed=lambda i: 30, cadence=lambda i: i % 90).unionByName(ride(spark, 100, 2, distance=lambda i: i * 0.01, speed=lambda i: 30, hr=lambda i: 120))
    rows = rows.unionByName(ride(spark, 100, 3, distance=lambda i: i * 0.01, speed=lambda i: 30))
    context = spark.createDataFrame([(i, 220.0, 50.0, 190.0, "male") for i in (1, 2, 3)], "activity_id long, ftp double, rest_hr double, top_hr double, sex string")
    told = [(1, 5.0, 500.0, 33.0, 60.0, 130.0, 170.0), (2, None, None, 0.0, None, 130.0, 170.0)]
    sessions = spark.createDataFrame(told, "activity_id long, total_distance_km double, total_timer_s double, avg_speed_kmh double, max_speed_kmh double, avg_hr double, max_hr double")
    got = {r["activity_id"]: r for r in summary.activity_summary(rows, context, sessions).collect()}
    pick = lambda i: tuple(round(got[i][c], 6) for c in ("distance_km", "duration_s", "avg_speed", "max_speed", "avg_hr", "max_hr", "max_cadence"))
    assert pick(1) == (5.0, 500.0, 33.0, 60.0, 130.0, 170.0, 89.0)
    assert pick(2) == (0.99, 99.0, 36.0, 30.0, 120.0, 120.0, 0.0)
    assert pick(3) == (0.99, 99.0, 36.0, 30.0, 0.0, 0.0, 0.0)


def test_suggestion_estimates_only_without_a_meter(spark):
    """One athlete with a meter, one that climbs without, one without rides; a record's heart rate can be the top."""
    from velotrace.operators import suggestion

    step = 18 / 3600
    climb = {"speed": lambda i: 18, "distance": lambda i: i * step, "alt": lambda i: 100 + i * step * 50, "lat": lambda i: 52, "lon": lambda i: 21 + i * step / 68.5, "hr": lambda i: 188}
    rows = ride(spark, 600, 1, power=lambda i: 200, hr=lambda i: 150).unionByName(ride(spark, 600, 2, **climb))
    activities = spark.createDataFrame([(1, 10, None, 180.0), (2, 20, 90.0, 180.0)], "activity_id long, athlete_id long, rider_mass_kg double, max_hr double")
    athletes = spark.createDataFrame([(a, "male", 60.0, 50.0, 75.0, 10.0) for a in (10, 20, 30)], "athlete_id long, sex string, age double, resting_hr double, rider_mass_kg double, bike_mass_kg double")
    got = {r["athlete_id"]: r for r in suggestion.athlete_suggestion(rows, activities, athletes, durations=(60, 300)).collect()}
    assert [got[a]["power_source"] for a in (10, 20, 30)] == ["measured", "estimated", "unavailable"]
    weight, v, angle = 100 * 9.80665, 5.0, math.atan(0.05)
    watts = (weight * math.sin(angle) * v + weight * 0.004 * math.cos(angle) * v + 0.5 * 1.225 * 0.25 * v**3) / 0.97
    assert got[10]["curve"][0]["power"] == 200 and got[20]["curve"][0]["power"] == pytest.approx(watts, rel=0.02)
    assert [p["power"] for p in got[30]["curve"]] == [0, 0] and got[30]["ftp_auto"] == 0 and got[30]["n_records"] == 0
    assert got[20]["observed_max"] == 188 and got[20]["max_hr"] == 188 and got[30]["max_hr"] == 160 and got[20]["n_timed"] == 0


def test_markers_and_overlay_grades(spark):
    from pyspark.sql import functions as F

    from velotrace.functions import scalars as S

    rows = spark.createDataFrame([(0.2, 2.0, 0.5), (0.0, 100.0, 0.5), (3.0, 3.0, 1.0), (0.1, 0.3, 1.0), (None, 3.0, 1.0)], "a double, b double, s double")
    assert [r[0] for r in rows.select(S.distance_markers("a", "b", F.col("s"))).collect()] == [[0.5, 1.0, 1.5, 2.0], [i * 2.0 for i in range(51)], [], [], []]
    graded = spark.createDataFrame([(1, 0.01, 5.0), (1, 0.02, None), (2, 0.03, None)], "activity_id int, grade double, stored double")
    assert sorted((r["activity_id"], r["grade_pct"]) for r in summary.overlay_grade(graded, "stored").collect() if r["grade_pct"] is not None) == [(1, 5.0), (2, 3.0)]


def test_ride_document_holds_profile_zones_and_segments(spark):
    sf = "/root/testdata/sf0.001"
    plain = {r["activity_id"]: r["document"] for r in jobs.QUERIES["t7_context_document"](spark, sf).collect()}
    full = {r["activity_id"]: r["document"] for r in jobs.QUERIES["t7_ride_context_document"](spark, sf).collect()}
    assert plain.keys() == full.keys() and all("**Rider:**" in d for d in full.values())
    ridden = [d for d in full.values() if "Heart-Rate Zones" in d]
    assert ridden and any("\n\n1. " in d for d in ridden)
    for i, d in plain.items():
        blocks = full[i].split("\n\n")
        assert all(b in blocks for b in d.split("\n\n"))
