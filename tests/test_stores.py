"""Imports, edits, log folders and listings: what is kept, what goes, what is read."""

import datetime
import os

from pyspark.sql import functions as F

from velotrace.operators import maintain

ACTIVITIES = "activity_id long, file_path string, total_distance_km double, rider_mass_kg double, bike_mass_kg double, manual_avg_hr double, manual_max_hr double, sport string"


def test_import_keeps_what_is_set_by_hand(spark):
    old = spark.createDataFrame([(1, "a", 10.0, None, 9.0, 120.0, 190.0, "run"), (2, "b", 20.0, 70.0, None, None, None, "bike")], ACTIVITIES)
    new = spark.createDataFrame(
        [(7, "a", 11.0, 80.0, 8.0, 1.0, 2.0, 5), (7, "a", 12.0, 81.0, 7.0, 1.0, 2.0, None), (9, "c", 30.0, 60.0, 6.0, 100.0, 150.0, None)],
        "activity_id long, file_path string, total_distance_km double, rider_mass_kg double, bike_mass_kg double, manual_avg_hr double, manual_max_hr double, imported_s long",
    )
    got = {r["file_path"]: tuple(r) for r in maintain.upsert_activities(old, new).collect()}
    assert got["a"] == (1, "a", 11.0, 80.0, 9.0, 120.0, 190.0, "run")  # the import without a time comes first, and its lack of a sport changes nothing
    assert got["b"] == (2, "b", 20.0, 70.0, None, None, None, "bike")
    assert got["c"] == (9, "c", 30.0, 60.0, 6.0, 100.0, 150.0, None)  # a file whose only import has no time is not lost


def test_edits(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 70.0, 9.0, 120.0, 190.0, "x"), (2, "b", 1.0, 71.0, 8.0, 121.0, 191.0, "x")], ACTIVITIES)
    analyses = spark.createDataFrame([(1,), (2,)], "activity_id long")
    edits = spark.createDataFrame([(1, None, 200.0)], "activity_id long, manual_avg_hr double, manual_max_hr double")
    changed, kept = maintain.override_activity_hr(rows, analyses, edits)
    assert {(r["activity_id"], r["manual_avg_hr"], r["manual_max_hr"]) for r in changed.collect()} == {(1, None, 200.0), (2, 121.0, 191.0)}
    assert [r["activity_id"] for r in kept.collect()] == [2]
    masses = maintain.set_activity_mass(rows, spark.createDataFrame([(2, None)], "activity_id long, bike_mass_kg double"))
    assert {(r["activity_id"], r["rider_mass_kg"], r["bike_mass_kg"]) for r in masses.collect()} == {(1, 70.0, 9.0), (2, 71.0, None)}


def test_log_days(spark, tmp_path):
    path = f"file://{tmp_path}/logs"
    days = [datetime.datetime(2024, 3, d, 12) for d in (1, 1, 5, 9, 10)]
    maintain.write_logs(spark.createDataFrame([(t, f"m{i}") for i, t in enumerate(days)], "ts timestamp, m string"), path)
    (tmp_path / "logs" / "log_date=2024-03-09" / "part-x.json").write_text('{"ts": "2024-03-09T13:00:00Z", "m": "late"}\n{broken\n')
    read = lambda: maintain.read_logs(spark, path, "ts timestamp, m string")
    assert read().where("broken IS NOT NULL").select("broken", "m").collect() == [("{broken", None)]
    late = read().where(F.col("log_date") >= "2024-03-09").select("m")
    assert {r["m"] for r in late.collect()} == {"m3", "m4", "late", None}
    assert "PartitionFilters: [isnotnull(log_date" in late._jdf.queryExecution().toString()
    assert maintain.drop_log_days(spark, path, 0, datetime.date(2024, 3, 10)) == []
    assert maintain.drop_log_days(spark, path, 5, datetime.date(2024, 3, 10)) == ["2024-03-01"]
    assert not os.path.exists(tmp_path / "logs" / "log_date=2024-03-01") and read().where("broken IS NULL").count() == 4


def test_listing_and_reading(spark, tmp_path):
    for name in ("a/x.fit", "a/y.FIT", "a/z.txt", "node_modules/q.fit", "b.c/.git/r.fit"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = maintain.list_recordings(spark, f"file://{tmp_path}")
    assert {(r["path"].rsplit("/", 1)[1], r["length"]) for r in found.collect()} == {("x.fit", 5), ("y.FIT", 5)}
    assert "content" not in found.columns


def test_readers_see_finished_batches_only(spark, tmp_path):
    from velotrace.streaming import indexing

    target = f"file://{tmp_path}/table"
    cols = "activity_id long, file_path string, total_distance_km double, rider_mass_kg double, manual_avg_hr double, imported_s long"
    batch = lambda km: spark.createDataFrame([(i, f"f{i}", km, None, None, 0) for i in range(20)], cols)
    indexing.merge_batch(batch(1.0), 0, target, 4)
    indexing.merge_batch(batch(2.0), 1, target, 4)
    mark = tmp_path / "table" / "version=0000000001" / "_SUCCESS"
    distances = lambda: {r["total_distance_km"] for r in indexing.latest_version(spark, target).collect()}
    assert distances() == {2.0}
    mark.unlink()  # as if the batch were still being written
    assert distances() == {1.0} and indexing.latest_version(spark, target).count() == 20
