"""Plans: records are shuffled once, whatever is measured on them."""

import re

import pytest
from pyspark.sql import functions as F

from velotrace.functions.shared import bucketed
from velotrace.operators import suggestion, summary
from velotrace.sources import adapters as A

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\((.*?)#", plan(df))


def test_summary_reads_its_records_where_they_lie(spark, shuffled_joins):
    records = A.records(spark, SF)
    context = spark.createDataFrame([(1, 200.0, 50.0, 190.0, "male")], "activity_id long, ftp double, rest_hr double, top_hr double, sex string")
    out = summary.activity_summary(records, context)
    text = plan(out)
    assert "Bucketed: true" in text and "events.parquet" not in text
    # the context alone is shuffled (and no session), once for each of its uses
    assert len(exchanges(out)) <= 3


def test_suggestion_shuffles_no_record_again(spark, shuffled_joins):
    activities, athletes = A.activities(spark, SF), A.athletes(spark, SF)
    out = suggestion.athlete_suggestion(A.records(spark, SF), activities, athletes, durations=(5, 10))
    assert "suggestion_records" not in plan(out) and "events.parquet" not in plan(out)
    assert len(exchanges(out)) <= 9  # rows per athlete only


def test_buckets_hold_all_rows(spark, shuffled_joins):
    table = spark.range(1000).select((F.col("id") % 7).alias("k"), "id", F.lit(None).cast("string").alias("none"))
    kept = bucketed(table, "t", "k")
    assert kept.schema.names == ["k", "id", "none"] and kept.count() == 1000
    assert not exchanges(kept.groupBy("k").agg(F.sum("id")))
    assert bucketed(table.limit(0), "t", "k").count() == 0
