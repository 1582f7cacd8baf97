"""What an athlete's rides say of their profile: top rate, zones, power curve and threshold power."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.shared import bucketed, materialize
from . import heart, power, series
from .clean import ACTIVITY, ORDER, stride_filter, valid_power
from .maintain import add_missing_columns


def athlete_suggestion(records: DataFrame, activities: DataFrame, athletes: DataFrame, durations: tuple[int, ...] = power.DURATIONS, stride: int = 5) -> DataFrame:
    """One row an athlete: automatic profile, best curve, threshold-power candidates and what they rest on.

    An athlete with any timed power is measured; for the others power is
    estimated from every ``stride``-th record, with the masses of the ride
    before those of the athlete. Records are dealt out by activity once and
    read where they lie; only a row per activity, or per activity and duration,
    is regrouped by athlete. Without any power the curve is 0 and the source
    ``unavailable``.
    """
    fields = [ACTIVITY, ORDER, "elapsed_ms", "elapsed_s", "distance_km", "speed_kmh", "heart_rate", "altitude_m", "position_lat", "position_long", "power"]
    records = bucketed(records.select(*fields), "suggestion_records", ACTIVITY)
    masses = athletes.select("athlete_id", F.col("rider_mass_kg").alias("_rider"), F.col("bike_mass_kg").alias("_bike"))
    owners = add_missing_columns(activities, {"bike_mass_kg": ("double", None)}).select(ACTIVITY, "athlete_id", "rider_mass_kg", "bike_mass_kg").join(masses, "athlete_id")
    owners = owners.select(ACTIVITY, "athlete_id", F.coalesce("rider_mass_kg", "_rider").alias("rider"), F.coalesce("bike_mass_kg", "_bike").alias("bike"))
    counts = records.groupBy(ACTIVITY).agg(
        F.count("*").alias("n_records"), F.count_if(valid_power()).alias("n_power"), F.count_if(valid_power() & F.col("elapsed_s").isNotNull()).alias("n_timed"), F.max("heart_rate").alias("record_max")
    )
    covered = materialize(owners.join(counts, ACTIVITY, "left"), "suggestion-covered")
    coverage = covered.groupBy("athlete_id").agg(
        F.count("*").alias("n_activities"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_records", "n_power", "n_timed")], F.max("record_max").alias("record_max")
    )
    coverage = materialize(coverage, "suggestion-coverage")
    flags = covered.where("n_records > 0").select(ACTIVITY, "athlete_id", "rider", "bike").join(coverage.select("athlete_id", (F.col("n_timed") > 0).alias("measured")), "athlete_id")
    owned = stride_filter(records.join(flags, ACTIVITY), F.when(F.col("measured"), 1).otherwise(stride))
    watts = F.when(F.col("measured"), F.col("power")).otherwise(series.estimate_power("rider", "bike"))
    rows = series.compute_grade(owned).withColumn("power", watts).where("power IS NOT NULL")
    owner = flags.select(ACTIVITY, F.col("athlete_id"))
    best = materialize(power.historical_mmp(power.mmp_curve(rows, durations).join(owner, ACTIVITY), "athlete_id"), "suggestion-best")
    points = F.array_sort(F.collect_list(F.struct("duration_s", F.round("power", 3).alias("power"))))
    curves = best.groupBy("athlete_id").agg(points.alias("curve"))
    fit = power.ftp_candidates(best, "athlete_id").withColumn("ftp_auto", power.select_ftp())
    observed = heart.observed_max_hr(activities, coverage.select("athlete_id", "record_max"))
    out = athletes.join(observed, "athlete_id", "left").join(coverage.drop("record_max"), "athlete_id", "left").join(curves, "athlete_id", "left").join(fit, "athlete_id", "left")
    source = F.when(F.col("n_timed") > 0, "measured").when(F.col("curve").isNotNull(), "estimated").otherwise("unavailable")
    flat = F.array(*[F.struct(F.lit(d).alias("duration_s"), F.lit(0.0).alias("power")) for d in durations])
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_activities", "n_records", "n_power", "n_timed")}
    filled = out.withColumn("power_source", source).withColumns(zero | {"curve": F.coalesce("curve", flat), "ftp_auto": F.coalesce("ftp_auto", F.lit(0.0))})
    filled = filled.withColumn("p", S.auto_hr_profile("sex", "age", "resting_hr", "observed_max"))
    return filled.select("athlete_id", "observed_max", "p.*", "ftp_auto", "cp_derived", "mmp_60min", "mmp_close_to_60min", "p20", "curve", "n_activities", "n_records", "n_power", "n_timed", "power_source")
