"""Texts of earlier rides in context documents."""

from pyspark.sql import functions as F

from velotrace import jobs
from velotrace.operators import history, summary

SF = "/root/testdata/sf0.001"


def test_context_documents_read_the_texts_once_and_move_them_by_athlete_only(spark):
    plan = jobs.QUERIES["t7_context_document"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "documents.parquet" in line]
    assert sum("text:string" in line for line in scans) == 1
    # nothing is dealt out again once the texts of earlier rides are beside a ride
    assert "lag(_own" in plan[: plan.index("Exchange")]


def test_history_by_lags_equals_history_by_pairs(spark):
    day = 86400
    starts = [10 * day] * 2 + [11 * day + i for i in range(5)] + [12 * day, 12 * day, 12 * day + 1, 80 * day, 200 * day, 200 * day]
    made = [(1 if i != 4 else 2, i, s, 20.05 + i, 100.0 * i, i % 3, i % 4 != 3 or None, f" text {i} ") for i, s in enumerate(starts)]
    names = "athlete_id long, activity_id long, start_s long, distance_km double, duration_s double, chat_count int, analysed boolean, analysis string"
    rides = spark.createDataFrame(made, names).withColumn("analysis", F.expr("IF(analysed, analysis, NULL)"))
    pairs = history.recent_analyses(rides, rides.where("analysed")).withColumnRenamed("other_start_s", "start_s")
    entries = pairs.join(rides.select(F.col("activity_id").alias("other_id"), "distance_km", "duration_s", "chat_count", F.col("analysis").alias("analysis_text")), "other_id")
    want = {r["activity_id"]: r["text"] for r in summary.recent_history_text(entries).collect()}
    rides = rides.withColumn("since", history.midnight_before()).join(summary.older_history_lines(entries), "activity_id", "left")
    got = {r["activity_id"]: r["history"] for r in summary.with_history(rides).collect()}
    assert len(want) > 8 and got == {i: want.get(i) for i in range(len(starts))}
    assert max(t.count("\n\n") for t in want.values()) > 4


def test_other_blocks_stand_around_the_history_in_their_order(spark):
    rides = spark.createDataFrame([(1, 1, 86400, 0, 10.0, 60.0), (1, 2, 172800, 0, 20.0, 60.0)], "athlete_id long, activity_id long, start_s long, since long, distance_km double, duration_s double")
    rides = rides.withColumn("older", F.lit(None).cast("array<string>"))
    block = lambda name: spark.createDataFrame([(i, f"{name} {i}") for i in (1, 2)], "activity_id long, text string")
    parts = {"profile": block("rider"), "history": None, "segments": block("parts"), "analysis": block("told"), "chat": block("said").withColumn("chat_count", F.lit(2))}
    got = {r["activity_id"]: r["document"] for r in summary.context_document(parts, rides.withColumn("n_prior", F.lit(0)).select("activity_id", "n_prior"), rides).collect()}
    assert got[1] == "rider 1\n\nparts 1\n\ntold 1\n\nsaid 1"
    entry = "1970-01-02 (10.0 km, 00:01:00):\ntold 1\n  (follow-up chat: 2 questions)"
    assert got[2] == f"rider 2\n\n{summary.HISTORY_TITLE}{entry}\n\nparts 2\n\ntold 2\n\nsaid 2"
