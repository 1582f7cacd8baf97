"""Power measures, mean-maximal curves and threshold-power candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import round_to
from . import kernels
from .clean import ACTIVITY, ORDER, valid_power
from .series import effort_runs, in_time, trailing_mean

DURATIONS = (60, 300, 600, 1200, 1800, 3000, 3300, 3600)


def normalized_power(records: DataFrame, seconds: int = 30) -> DataFrame:
    """``activity_id, np``: fourth root of the mean fourth power of the trailing mean."""
    rows = records.where(valid_power()).select(ACTIVITY, F.coalesce("elapsed_ms", F.col(ORDER) * 1000).alias("elapsed_ms"), "power")
    return rows.select(ACTIVITY, trailing_mean("power", seconds).alias("m")).groupBy(ACTIVITY).agg(F.pow(F.avg(F.pow("m", F.lit(4))), F.lit(0.25)).alias("np"))


def x_power(records: DataFrame, tau: float = 25.0) -> DataFrame:
    """``activity_id, xpower``: the same over an exponentially weighted trace.

    The trace is a recursion, so each activity is folded in time order inside
    the JVM (an activity has at most some 100,000 rows).
    """
    rows = records.where(valid_power()).select(ACTIVITY, F.struct(ORDER, F.coalesce("elapsed_s", F.col(ORDER).cast("double")).alias("t"), "power").alias("r"))
    fold = f"""aggregate(s, named_struct('t', s[0].t, 'f', s[0].power, 'q', 0D, 'n', 0L), (a, r) -> named_struct('t', r.t,
      'f', IF(a.n = 0, r.power, a.f + (1 - exp(-IF(r.t - a.t > 0, least(r.t - a.t, 30D), 1D) / {tau}D)) * (r.power - a.f)),
      'q', a.q + power(IF(a.n = 0, r.power, a.f + (1 - exp(-IF(r.t - a.t > 0, least(r.t - a.t, 30D), 1D) / {tau}D)) * (r.power - a.f)), 4D), 'n', a.n + 1),
      a -> power(a.q / a.n, 0.25D))"""
    return rows.groupBy(ACTIVITY).agg(F.array_sort(F.collect_list("r")).alias("s")).select(ACTIVITY, F.expr(fold).alias("xpower"))


def mmp_curve(records: DataFrame, durations: tuple[int, ...] = DURATIONS, gap: float = 5.0) -> DataFrame:
    """``activity_id, duration_s, power``: best mean over ``[t, t + d]`` inside a run that spans d; 0 if there is none.

    A window that spans d ends in a row at ``t + d``, so prefix sums and a frame
    of that one time give its mean: a few rows in memory, whatever the duration,
    and one shuffle and sort for all durations. Rows of equal time count together.
    """
    rows = effort_runs(records, gap).select(ACTIVITY, "run", "elapsed_ms", "power")
    w, best = in_time("run"), []
    upto, before = w.rangeBetween(W.unboundedPreceding, 0), w.rangeBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_upto": F.struct(F.sum("power").over(upto).alias("p"), F.count("*").over(upto).alias("n")),
        "_p": F.coalesce(F.sum("power").over(before), F.lit(0.0)), "_n": F.count("*").over(before),
    })
    for d in durations:
        end = F.first("_upto").over(w.rangeBetween(d * 1000, d * 1000))
        rows = rows.withColumn(f"_m{d}", (end["p"] - F.col("_p")) / (end["n"] - F.col("_n")))
        best.append(F.struct(F.lit(d).alias("duration_s"), F.coalesce(F.max(f"_m{d}"), F.lit(0.0)).alias("power")))
    return rows.groupBy(ACTIVITY).agg(F.array(*best).alias("c")).select(ACTIVITY, F.explode("c").alias("c")).select(ACTIVITY, "c.*")


def historical_mmp(curves: DataFrame, *keys: str) -> DataFrame:
    """Best power per duration (and ``keys``) over all activities."""
    return curves.groupBy(*keys, "duration_s").agg(F.max("power").alias("power"))


def auto_ftp(records: DataFrame, seconds: int = 1200, span: int = 1140, gap: float = 5.0, share: float = 0.95) -> DataFrame:
    """``activity_id, ftp``: share of the best mean over windows of at most ``seconds`` that span at least ``span``."""
    w = in_time("run").rangeBetween(0, seconds * 1000)
    rows = effort_runs(records, gap)
    mean = F.when(F.max("elapsed_ms").over(w) - F.col("elapsed_ms") >= span * 1000, F.avg("power").over(w))
    best = rows.withColumn("_m", mean).groupBy(ACTIVITY).agg(round_to(F.max("_m") * share).alias("ftp"))
    return best.select(ACTIVITY, F.when(F.col("ftp").between(80, 500), F.col("ftp")).otherwise(0.0).alias("ftp"))


def ftp_candidates(curve: DataFrame, *keys: str) -> DataFrame:
    """Columns ``cp, w_prime, r_squared, cp_derived, mmp_60min, mmp_close_to_60min, p20``: NULL where not given.

    Critical power is the regression of power on 1/duration over at least
    three positive points with cp > 0, slope >= 0 and R² >= 0.85.
    """
    on = F.col("power") > 0
    x, y = F.when(on, 1.0 / F.col("duration_s")), F.when(on, F.col("power"))
    at = lambda d: F.max(F.when((F.col("duration_s") == d) & on, F.col("power")))
    fit = curve.groupBy(*keys).agg(
        F.count(y).alias("_n"), F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"),
        F.when(F.var_pop(y) == 0, 0.0).otherwise(F.regr_r2(y, x)).alias("_r"),
        at(3600).alias("mmp_60min"), F.when(at(3600).isNull(), F.coalesce(at(3300), at(3000))).alias("mmp_close_to_60min"), (at(1200) * 0.95).alias("p20"),
    )
    ok = (F.col("_n") >= 3) & (F.col("_i") > 0) & (F.col("_s") >= 0) & (F.col("_r") >= 0.85)
    named = [F.when(ok, F.col(c)).alias(n) for c, n in (("_i", "cp"), ("_s", "w_prime"), ("_r", "r_squared"))]
    return fit.select(*keys, *named, F.when(ok, F.col("_i") * 0.97).alias("cp_derived"), "mmp_60min", "mmp_close_to_60min", "p20")


def select_ftp(*candidates: str) -> Column:
    """The first candidate between 80 and 500, rounded, else 0."""
    order = candidates or ("cp_derived", "mmp_60min", "mmp_close_to_60min", "p20")
    return F.coalesce(*[F.when(F.col(c).between(80, 500), round_to(c)) for c in order], F.lit(0.0))


def power_coverage(records: DataFrame) -> DataFrame:
    """``activity_id, n_records, n_power, n_timed, power_source``; without measured power, estimates need a column ``estimated``."""
    guessed = F.count("estimated") > 0 if "estimated" in records.columns else F.lit(False)
    counts = records.groupBy(ACTIVITY).agg(F.count("*").alias("n_records"), F.count_if(valid_power()).alias("n_power"), F.count_if(valid_power() & F.col("elapsed_s").isNotNull()).alias("n_timed"), guessed.alias("_g"))
    return counts.withColumn("power_source", F.when(F.col("n_timed") > 0, "measured").when(F.col("_g"), "estimated").otherwise("unavailable")).drop("_g")


def decoupling(records: DataFrame, limits: DataFrame) -> DataFrame:
    """``activity_id, decoupling_pct``; ``limits`` has ``activity_id, ftp, rest_hr, top_hr``."""

    def drift(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        ftp, rest, top = (float(pdf[c].iloc[0]) if pd.notna(pdf[c].iloc[0]) else np.nan for c in ("ftp", "rest_hr", "top_hr"))
        value = kernels.decoupling(pdf["elapsed_s"], pdf["power"], pdf["heart_rate"], ftp, rest, top)
        return pd.DataFrame({ACTIVITY: [pdf[ACTIVITY].iloc[0]], "decoupling_pct": [value]})

    rows = records.select(ACTIVITY, ORDER, "elapsed_s", "power", "heart_rate").join(limits.select(ACTIVITY, "ftp", "rest_hr", "top_hr"), ACTIVITY)
    return rows.groupBy(ACTIVITY).applyInPandas(drift, f"{ACTIVITY} long, decoupling_pct double")


def elevation_gain_loss(records: DataFrame, hysteresis: float = 3.0, n: int = 5) -> DataFrame:
    """``activity_id, gain_m, loss_m``: the smoothed altitude counts once it has moved by the hysteresis."""
    rows = records.where("altitude_m IS NOT NULL").withColumn("a", F.avg("altitude_m").over(W.partitionBy(ACTIVITY).orderBy(ORDER).rowsBetween(-(n // 2), n // 2)))
    fold = f"""aggregate(s, named_struct('ref', s[0].a, 'up', 0D, 'down', 0D), (x, r) -> IF(abs(r.a - x.ref) >= {hysteresis}D,
      named_struct('ref', r.a, 'up', x.up + greatest(r.a - x.ref, 0D), 'down', x.down + greatest(x.ref - r.a, 0D)), x))"""
    folded = rows.groupBy(ACTIVITY).agg(F.array_sort(F.collect_list(F.struct(ORDER, "a"))).alias("s")).select(ACTIVITY, F.expr(fold).alias("e"))
    return folded.select(ACTIVITY, F.col("e.up").alias("gain_m"), F.col("e.down").alias("loss_m"))
