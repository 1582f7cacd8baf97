"""Cleaning of sample series: smoothing, derived speeds, row shapes, filters.

All windows are partitioned by activity in record order, so a chain of them
shuffles once; an activity has at most some 100,000 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import col, haversine_km, round_to, valid_fix

ACTIVITY, ORDER = "activity_id", "record_index"


def in_order(*more: str):
    """Window over one activity (and ``more`` keys) in record order."""
    return W.partitionBy(ACTIVITY, *more).orderBy(ORDER)


def smooth(c, n: int, window=None) -> Column:
    """Centred mean over the finite values of n rows, shorter at the ends; it also fills gaps."""
    w = (window or in_order()).rowsBetween(-(n // 2), n // 2)
    return F.coalesce(F.avg(col(c)).over(w), col(c))


def before(*columns, window=None) -> Column:
    """Struct of the columns of the last earlier row that has all of them."""
    w = (window or in_order()).rowsBetween(W.unboundedPreceding, -1)
    ok = F.lit(True)
    for c in columns:
        ok = ok & col(c).isNotNull()
    return F.last(F.when(ok, F.struct(*columns)), ignorenulls=True).over(w)


def derive_speed_from_distance(records: DataFrame, max_gap: float = 30.0, n: int = 5) -> DataFrame:
    """Adds ``derived_kmh`` from distance over time since the last row with both."""
    p = before("elapsed_s", "distance_km")
    out = records.withColumn("_p", p)
    dt, dd = F.col("elapsed_s") - F.col("_p.elapsed_s"), F.col("distance_km") - F.col("_p.distance_km")
    raw = F.when((dt > 0) & (dt <= max_gap) & (dd >= 0), dd / dt * 3600)
    return out.withColumn("_raw", raw).withColumn("derived_kmh", smooth("_raw", n)).drop("_p", "_raw")


def enhanced_fallback(records: DataFrame, speed="enhanced_speed", altitude="enhanced_altitude") -> DataFrame:
    """``speed_kmh`` from a positive enhanced speed where it is not positive itself, ``altitude_m`` from the enhanced one where it is missing."""
    own, other = F.col("speed_kmh"), F.when(col(speed) > 0, col(speed))
    return records.withColumns({"speed_kmh": F.when(own > 0, own).otherwise(F.coalesce(other, own)), "altitude_m": F.coalesce("altitude_m", col(altitude))})


def normalize_speeds(records: DataFrame) -> DataFrame:
    """``speed_kmh``: recorded above 0, else derived; a recorded 0 needs over 1 km/h derived."""
    out = derive_speed_from_distance(records)
    speed, d = F.col("speed_kmh"), F.col("derived_kmh")
    return out.withColumn("speed_kmh", F.when(speed > 0, speed).when(speed.isNull(), d).when(d > 1, d).otherwise(speed))


def gps_speed(records: DataFrame, max_gap: float = 30.0, n: int = 5) -> DataFrame:
    """Adds ``gps_kmh`` between consecutive fixes."""
    fixed = records.withColumn("_lat", F.when(valid_fix(), F.col("position_lat"))).withColumn("_lon", F.when(valid_fix(), F.col("position_long")))
    out = fixed.withColumn("_p", before("elapsed_s", "_lat", "_lon"))
    dt = F.col("elapsed_s") - F.col("_p.elapsed_s")
    raw = F.when((dt > 0) & (dt <= max_gap), haversine_km("_p._lat", "_p._lon", "_lat", "_lon") / dt * 3600)
    return out.withColumn("_raw", raw).withColumn("gps_kmh", smooth("_raw", n)).drop("_p", "_raw", "_lat", "_lon")


def record_rows(graded: DataFrame) -> DataFrame:
    """Rows as they are stored: no position without a fix, zero cadence and temperature as NULL, stored grade."""
    steady = (F.col("dt") > 0) & (F.col("dt") <= 5) & (F.col("step_m") >= 1)
    return graded.select(
        ACTIVITY, ORDER, "elapsed_s", "distance_km", "speed_kmh", "heart_rate", "altitude_m",
        F.when(valid_fix(), F.col("position_lat")).alias("position_lat"), F.when(valid_fix(), F.col("position_long")).alias("position_long"),
        F.nullif("cadence", F.lit(0.0)).alias("cadence"), F.nullif("temperature", F.lit(0.0)).alias("temperature"), "power",
        F.when(steady, round_to(F.col("grade") * 100, 2)).alias("grade_pct"),
    )


def valid_power(c="power") -> Column:
    return F.coalesce(col(c) >= 0, F.lit(False))


def stride_filter(records: DataFrame, n: int | Column) -> DataFrame:
    """Every n-th record by its index."""
    return records.where(F.col(ORDER) % n == 0)


def project_xy(records: DataFrame, x, y) -> DataFrame:
    """Points ``x, y`` of the rows that have both."""
    return records.select(ACTIVITY, ORDER, col(x).alias("x"), col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
