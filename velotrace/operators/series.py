"""Window operators over the samples of an activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import valid_fix
from .clean import ACTIVITY, ORDER, in_order, smooth, valid_power

GRAVITY, AIR, ROLLING, DRAG, DRIVETRAIN, MOST_WATTS = 9.80665, 1.225, 0.004, 0.25, 0.97, 1200.0


def in_time(*more: str):
    return W.partitionBy(ACTIVITY, *more).orderBy("elapsed_ms")


def trailing_mean(c: str, seconds: int, *keys: str) -> Column:
    """Mean of the rows later than ``t - seconds`` up to the row (rows of equal time count together)."""
    return F.avg(c).over(in_time(*keys).rangeBetween(-(seconds * 1000 - 1), 0))


def compute_grade(records: DataFrame, n: int = 5) -> DataFrame:
    """Adds ``grade, dt, step_m, step_ms`` (metres per second) on rows with time, speed, altitude and fix.

    The windows run over usable rows only, as a second partition key, so
    nothing is joined back and nothing more is shuffled.
    """
    usable = F.coalesce(F.col("elapsed_s").isNotNull() & F.col("speed_kmh").isNotNull() & F.col("altitude_m").isNotNull() & valid_fix(), F.lit(False))
    w = in_order("_use")
    out = records.withColumn("_use", usable).withColumn("_alt", F.when(F.col("_use"), smooth("altitude_m", n, w)))
    out = out.withColumn("_v", F.greatest("speed_kmh", F.lit(0.0)) / 3.6)
    back = lambda c: F.lag(c).over(w)
    out = out.withColumn("dt", F.when(F.col("_use"), F.col("elapsed_s") - back("elapsed_s")))
    out = out.withColumn("step_ms", F.when(F.col("dt").isNotNull(), (back("_v") + F.col("_v")) / 2))
    driven = (F.coalesce("distance_km", F.lit(0.0)) - F.coalesce(back("distance_km"), F.lit(0.0))) * 1000
    out = out.withColumn("_driven", F.when(F.col("dt").isNotNull(), driven)).withColumn("_rise", F.col("_alt") - back("_alt"))
    out = out.withColumn("step_m", F.when(F.col("_driven") > 0, F.col("_driven")).otherwise(F.col("step_ms") * F.col("dt")))
    return out.withColumn("grade", F.col("_rise") / F.greatest("step_m", F.lit(1.0))).drop("_use", "_alt", "_v", "_driven", "_rise")


def grade_series_pct(graded: DataFrame, n: int = 15, stored: str | None = None) -> DataFrame:
    """Adds ``grade_pct``: the stored grade, else the computed one on steady steps, smoothed."""
    own = F.when((F.col("dt") > 0) & (F.col("dt") <= 5) & (F.col("step_m") >= 1), F.col("grade") * 100)
    raw = F.coalesce(F.col(stored), own) if stored else own
    return graded.withColumn("_g", raw).withColumn("grade_pct", smooth("_g", n)).drop("_g")


def estimate_power(rider, bike, drag: float = DRAG) -> Column:
    """Watts from motion on rows of :func:`compute_grade`; NULL where the model does not hold."""
    rider, bike = (F.col(c) if isinstance(c, str) else c for c in (rider, bike))
    weight, v, angle = (rider + bike) * GRAVITY, F.col("step_ms"), F.atan("grade")
    wheel = weight * F.sin(angle) * v + weight * ROLLING * F.cos(angle) * v + 0.5 * AIR * drag * v * v * v
    watts = F.least(F.lit(MOST_WATTS), F.greatest(F.lit(0.0), wheel) / DRIVETRAIN)
    sound = (F.col("dt") > 0) & (F.col("dt") <= 5) & (v >= 0.5) & (F.abs("grade") <= 0.18) & (rider > 0) & (bike >= 0)
    return F.when(sound, watts)


def add_estimated_power(graded: DataFrame, rider, bike) -> DataFrame:
    """``power`` and ``power_source`` of each activity: measured, estimated or unavailable."""
    own = W.partitionBy(ACTIVITY)
    out = graded.withColumn("_e", estimate_power(rider, bike))
    measured, estimated = F.max(valid_power()).over(own), F.max(F.col("_e").isNotNull()).over(own)
    out = out.withColumn("power_source", F.when(measured, "measured").when(estimated, "estimated").otherwise("unavailable"))
    # rows of equal time share the last estimate
    last = F.last("_e", ignorenulls=True).over(W.partitionBy(ACTIVITY, "elapsed_ms").orderBy(ORDER).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return out.withColumn("power", F.when(F.col("power_source") == "estimated", F.coalesce("power", last)).otherwise(F.col("power"))).drop("_e")


def record_duration(most: float = 30.0) -> Column:
    """Seconds that a row stands for: up to the next row if within (0, most], else 1; the last one the median."""
    dt = F.lead("_t").over(in_order()) - F.col("_t")
    return F.when(dt.isNull(), None).when((dt > 0) & (dt <= most), dt).otherwise(1.0)


def with_record_duration(records: DataFrame, most: float = 30.0) -> DataFrame:
    """Adds ``seconds``; a missing time counts as 0."""
    own = W.partitionBy(ACTIVITY)
    out = records.withColumn("_t", F.coalesce("elapsed_s", F.lit(0.0)))
    out = out.withColumn("_d", F.lead("_t").over(in_order()) - F.col("_t")).withColumn("_s", record_duration(most))
    middle = F.coalesce(F.median(F.when((F.col("_d") > 0) & (F.col("_d") <= most), F.col("_d"))).over(own), F.lit(1.0))
    return out.withColumn("seconds", F.coalesce("_s", middle)).drop("_t", "_d", "_s")


def effort_runs(records: DataFrame, gap: float = 5.0) -> DataFrame:
    """Rows with time and valid power, in time order, with ``run``: a new one after more than ``gap`` seconds."""
    w = W.partitionBy(ACTIVITY).orderBy("elapsed_ms", ORDER)
    rows = records.where(F.col("elapsed_ms").isNotNull() & valid_power())
    new = F.coalesce(F.col("elapsed_ms") - F.lag("elapsed_ms").over(w) > gap * 1000, F.lit(False)).cast("int")
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def stop_runs(records: DataFrame, speed: float = 1.0, least: float = 10.0) -> DataFrame:
    """``start_index, end_index, start_s, end_s`` of slow runs of at least ``least`` seconds; a missing speed ends a run."""
    slow = F.coalesce(F.col("speed_kmh") <= speed, F.lit(False))
    rows = records.withColumn("_slow", slow).withColumn("_new", (F.col("_slow") != F.lag("_slow", 1, False).over(in_order())).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(in_order())).where("_slow")
    return _stops(rows.groupBy(ACTIVITY, "_run").agg(
        F.min(ORDER).alias("start_index"), F.max(ORDER).alias("end_index"), F.min_by("elapsed_s", ORDER).alias("start_s"), F.max_by("elapsed_s", ORDER).alias("end_s")
    ), least)


def _stops(rows: DataFrame, least: float) -> DataFrame:
    return rows.where(F.col("end_s") - F.col("start_s") >= least).select(ACTIVITY, "start_index", "end_index", "start_s", "end_s")


def recording_gaps(records: DataFrame, gap: float = 10.0) -> DataFrame:
    """The same for consecutive rows at least ``gap`` seconds apart."""
    back = lambda c: F.lag(c).over(in_order())
    rows = records.select(ACTIVITY, back(ORDER).alias("start_index"), F.col(ORDER).alias("end_index"), back("elapsed_s").alias("start_s"), F.col("elapsed_s").alias("end_s"))
    return _stops(rows, gap)


def detect_stops(records: DataFrame, speed: float = 1.0, least: float = 10.0, gap: float = 10.0) -> DataFrame:
    """Union of slow runs and gaps; overlapping ones merged."""
    both = stop_runs(records, speed, least).unionByName(recording_gaps(records, gap))
    w = W.partitionBy(ACTIVITY).orderBy("start_index", "end_index")
    reach = F.max("end_index").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = both.withColumn("_new", F.coalesce(F.col("start_index") > reach, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    merged = rows.groupBy(ACTIVITY, "_island").agg(
        F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.min_by("start_s", "start_index").alias("start_s"), F.max_by("end_s", "end_index").alias("end_s")
    )
    return merged.drop("_island").withColumn("duration_s", F.col("end_s") - F.col("start_s"))


def mark_intervals(records: DataFrame, intervals: DataFrame, flag: str = "stopped") -> DataFrame:
    """Adds a boolean: the record lies in one of its activity's intervals (which do not overlap).

    The interval starts are laid over the records by a union and carried
    forward, so the cost is one sort and never records times intervals.
    """
    starts = intervals.select(ACTIVITY, F.col("start_index").alias(ORDER), F.col("end_index").alias("_end"))
    latest = records.join(starts, [ACTIVITY, ORDER], "left")
    end = F.last("_end", ignorenulls=True).over(in_order().rowsBetween(W.unboundedPreceding, 0))
    return latest.withColumn(flag, F.coalesce(F.col(ORDER) <= end, F.lit(False))).drop("_end")


def terrain_state(marked: DataFrame, threshold: float = 2.5, hysteresis: float = 0.5) -> DataFrame:
    """Adds ``terrain``: climb, flat, descent or stopped, with hysteresis and without recursion.

    Every usable row falls in a band; a row between the limits takes climb
    (descent) exactly if the last row outside that band was a climb (descent).
    """
    if not 0 <= hysteresis <= threshold:
        raise ValueError("hysteresis must lie between 0 and the threshold")
    g, up, low = F.col("grade_pct"), threshold + hysteresis, threshold - hysteresis
    usable = g.isNotNull() & ~F.col("stopped")
    band = F.when(~usable, None).when(g > up, "C").when(g < -up, "D").when(g >= low, "U").when(g <= -low, "L").otherwise("F")
    so_far = in_order().rowsBetween(W.unboundedPreceding, 0)
    rows = marked.withColumn("_b", band)
    rows = rows.withColumn("_u", F.last(F.when(F.col("_b") != "U", F.col("_b")), True).over(so_far)).withColumn("_l", F.last(F.when(F.col("_b") != "L", F.col("_b")), True).over(so_far))
    state = (
        F.when(F.col("_b") == "C", "climb").when(F.col("_b") == "D", "descent").when(F.col("_b") == "F", "flat")
        .when(F.col("_b") == "U", F.when(F.col("_u") == "C", "climb").otherwise("flat"))
        .when(F.col("_b") == "L", F.when(F.col("_l") == "D", "descent").otherwise("flat"))
    )
    rows = rows.withColumn("_s", state)
    kept = F.coalesce(F.last("_s", True).over(so_far), F.lit("flat"))
    return rows.withColumn("terrain", F.when(F.col("stopped"), "stopped").otherwise(kept)).drop("_b", "_u", "_l", "_s")


def runs_of(rows: DataFrame, c: str, out: str = "run") -> DataFrame:
    """Adds the number of the run of equal values that a row belongs to."""
    new = F.coalesce(F.col(c) != F.lag(c).over(in_order()), F.lit(True)).cast("int")
    return rows.withColumn("_new", new).withColumn(out, F.sum("_new").over(in_order())).drop("_new")


def terrain_runs(states: DataFrame) -> DataFrame:
    """``run, terrain, start_index, end_index, start_s, end_s`` of equal consecutive states."""
    return runs_of(states, "terrain").groupBy(ACTIVITY, "run").agg(
        F.first("terrain").alias("terrain"), F.min(ORDER).alias("start_index"), F.max(ORDER).alias("end_index"), F.min_by("elapsed_s", ORDER).alias("start_s"), F.max_by("elapsed_s", ORDER).alias("end_s")
    )


def downsample(rows: DataFrame, most: int, order: str = ORDER, *keys: str) -> DataFrame:
    """At most ``most`` rows of each activity: those at ``floor(k * n / most)``."""
    own = W.partitionBy(ACTIVITY, *keys)
    out = rows.withColumn("_i", F.row_number().over(own.orderBy(order)) - 1).withColumn("_n", F.count("*").over(own))
    step, k = F.col("_n") / float(most), F.floor(F.col("_i") / (F.col("_n") / float(most)))
    hit = F.lit(False)
    for d in (-1, 0, 1):
        hit = hit | ((k + d >= 0) & (k + d < most) & (F.floor((k + d) * step) == F.col("_i")))
    return out.where((F.col("_n") <= most) | hit).drop("_i", "_n")
