"""Steps, angles and mean squared displacement of cleaned runs (keys, rn, time, x, y, theta)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Dynamics
from ..functions.columns import speed

KEYS = ("run_id",)


def _by(keys):
    return W.partitionBy(*keys).orderBy("rn")


def time_steps(rows: DataFrame, keys=KEYS) -> DataFrame:
    return rows.withColumn("dt", F.col("time") - F.lag("time").over(_by(keys)))


def mean_step(rows: DataFrame, keys=KEYS) -> DataFrame:
    """n and mean time step of each run; null with fewer than two rows."""
    n = F.count("*")
    return rows.groupBy(*keys).agg(n.alias("n"), F.when(n > 1, (F.max("time") - F.min("time")) / F.nullif(n - 1, F.lit(0))).alias("mean_dt"))


def unwrap(rows: DataFrame, keys=KEYS) -> DataFrame:
    """theta_u: theta in radians without jumps of more than half a turn."""
    pi = math.pi
    out = rows.withColumn("_t", F.radians("theta"))
    out = out.withColumn("_d", F.col("_t") - F.lag("_t").over(_by(keys)))
    m = F.pmod(F.col("_d") + pi, F.lit(2 * pi)) - pi
    m = F.when((m == -pi) & (F.col("_d") > 0), F.lit(pi)).otherwise(m)
    turn = F.when(F.abs("_d") < pi, 0.0).otherwise(m - F.col("_d"))
    out = out.withColumn("_c", F.coalesce(turn, F.lit(0.0)))
    return out.withColumn("theta_u", F.col("_t") + F.sum("_c").over(_by(keys))).drop("_t", "_d", "_c")


def gradient(rows: DataFrame, value: str = "theta_u", out: str = "dtheta", keys=KEYS) -> DataFrame:
    """The derivative by time: second order within, one-sided at the ends; null in runs of one row."""
    w = _by(keys)
    f, t = F.col(value), F.col("time")
    back, ahead = t - F.lag("time").over(w), F.lead("time").over(w) - t
    was, then = F.lag(value).over(w), F.lead(value).over(w)
    inner = (back * back * then + (ahead * ahead - back * back) * f - ahead * ahead * was) / (back * ahead * (back + ahead))
    return rows.withColumn(out, F.when(back.isNull(), (then - f) / ahead).when(ahead.isNull(), (f - was) / back).otherwise(inner))


def omega_noise(rows: DataFrame, keys=KEYS) -> DataFrame:
    """The size of the mean angular velocity."""
    return gradient(unwrap(rows, keys), keys=keys).groupBy(*keys).agg(F.abs(F.avg("dtheta")).alias("omega_noise"))


#: Rows of a run that are gathered at a time.
PIECE = 4096


def msd_curve(rows: DataFrame, keys=KEYS, d: Dynamics = Dynamics(), piece: int = PIECE) -> DataFrame:
    """(keys, n, dt, n_taus, tau, tau2, msd). Rows are gathered in order, in pieces of a run that overlap by the largest lag, and
    the pieces' sums add up: so no row is shuffled once for each lag, and no array grows with a run. Lags are 1 .. min(int(max / dt), n) - 1."""
    every = W.partitionBy(*keys)
    n, dt = F.count("*").over(every), (F.max("time").over(every) - F.min("time").over(every)) / F.nullif(F.count("*").over(every) - 1, F.lit(0))
    out = rows.select(*keys, (F.row_number().over(_by(keys)) - 1).alias("_i"), "x", "y", n.alias("n"), dt.alias("dt")).where("n > 1 AND dt > 0")
    out = out.withColumn("n_taus", F.least((d.max_tau_seconds / F.col("dt")).cast("int"), F.col("n").cast("int")) - 1).where("n_taus > 0")
    out = out.withColumn("_size", F.greatest(F.lit(piece), F.col("n_taus"))).withColumn("_own", F.floor(F.col("_i") / F.col("_size")))
    both = (F.col("_own") > 0) & (F.col("_i") % F.col("_size") < F.col("n_taus"))  # ends of steps that begin in the piece before
    out = out.withColumn("_piece", F.explode(F.when(both, F.array("_own", F.col("_own") - 1)).otherwise(F.array("_own"))))
    pieces = out.groupBy(*keys, "_piece").agg(*(F.first(c).alias(c) for c in ("n", "dt", "n_taus", "_size")), F.array_sort(F.collect_list(F.struct("_i", "x", "y"))).alias("p"))
    lags = pieces.withColumn("tau", F.explode(F.sequence(F.lit(1), F.col("n_taus"))))
    begin = F.least(F.col("_size").cast("long"), F.col("n") - F.col("_piece") * F.col("_size"))
    left = F.least(begin, F.size("p") - F.col("tau")).cast("int")
    steps = F.zip_with(F.slice("p", F.col("tau") + 1, left), F.slice("p", F.lit(1), left), lambda a, b: (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))
    lags = lags.where(left > 0).select(*keys, "n", "dt", "n_taus", "tau", F.aggregate(steps, F.lit(0.0), lambda s, v: s + v).alias("_sum"))
    sums = lags.groupBy(*keys, "tau").agg(*(F.first(c).alias(c) for c in ("n", "dt", "n_taus")), F.sum("_sum").alias("_sum"))
    s = F.col("tau") * F.col("dt")
    return sums.select(*keys, "n", "dt", "n_taus", "tau", (s * s).alias("tau2"), (F.col("_sum") / (F.col("n") - F.col("tau"))).alias("msd"))


def msd_fit(curve: DataFrame, keys=KEYS, d: Dynamics = Dynamics()) -> DataFrame:
    """(keys, n_fit, slope, intercept, v_msd): least squares with intercept over the first int(share * lags) lags. One
    lag gives slope 0; a run without any isn't there."""
    fit = curve.withColumn("n_fit", (F.col("n_taus") * d.taus_percentage).cast("int")).where("tau <= n_fit")
    out = fit.groupBy(*keys).agg(F.first("n_fit").alias("n_fit"), F.regr_slope("msd", "tau2").alias("slope"), F.regr_intercept("msd", "tau2").alias("intercept"), F.avg("msd").alias("_m"))
    out = out.withColumn("slope", F.coalesce("slope", F.lit(0.0))).withColumn("intercept", F.coalesce("intercept", "_m")).drop("_m")
    return out.withColumn("v_msd", speed(F.col("slope")))


def msd_mean(curve: DataFrame, by: list[str]) -> DataFrame:
    """The mean curve of all runs with equal `by` at each lag, and whether all of them have the lag."""
    trials = curve.groupBy(*by).agg(F.count_if(F.col("tau") == 1).alias("_runs"))
    out = curve.groupBy(*by, "tau").agg(F.avg("tau2").alias("tau2"), F.avg("msd").alias("msd"), F.count("*").alias("n_runs"))
    return out.join(trials, by).withColumn("in_all", F.col("n_runs") == F.col("_runs")).drop("_runs")
