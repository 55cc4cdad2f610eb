"""Cleaning of runs: edges, gaps, walls. Rows are (keys, time, x, y, theta ..); every step keeps one exchange by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Dynamics, Tracking
from ..functions.columns import measured, outside, skipped

KEYS = ("run_id",)


def positions(rows: DataFrame, keys=KEYS, order: str = "time") -> DataFrame:
    """rn: the row's place in its run, from 0."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)


def trim_edges(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Without skipped rows before the first and after the last detection, with rn counted anew. A run that is skipped as a whole goes."""
    every = W.partitionBy(*keys)
    out = positions(rows, keys)
    out = out.withColumn("_first", F.min(F.when(~skipped(), F.col("rn"))).over(every)).withColumn("_last", F.max(F.when(~skipped(), F.col("rn"))).over(every))
    return out.where((F.col("rn") >= F.col("_first")) & (F.col("rn") <= F.col("_last"))).withColumn("rn", F.col("rn") - F.col("_first")).drop("_first", "_last")


def _marked(rows: DataFrame, keys) -> DataFrame:
    """rows with rn and, of each: whether it is skipped (_s), the run's first and last detection (_first, _last), whether it lies between
    them (_mid), and then the length of its stretch of skipped rows (_len). All windows share the partitioning by run."""
    every = W.partitionBy(*keys)
    out = (rows if "rn" in rows.columns else positions(rows, keys)).withColumn("_s", skipped())
    out = out.withColumn("_first", F.min(F.when(~F.col("_s"), F.col("rn"))).over(every)).withColumn("_last", F.max(F.when(~F.col("_s"), F.col("rn"))).over(every))
    out = out.withColumn("_mid", F.coalesce((F.col("rn") >= F.col("_first")) & (F.col("rn") <= F.col("_last")), F.lit(False)))
    # a stretch of skipped rows: place less place among the run's skipped rows
    out = out.withColumn("_stretch", F.col("rn") - F.row_number().over(W.partitionBy(*keys, "_s").orderBy("rn")))
    return out.withColumn("_len", F.when(F.col("_s") & F.col("_mid"), F.count("*").over(W.partitionBy(*keys, "_s", "_stretch"))))


#: Columns of _marked() and _kept().
_MARKS = ("_s", "_first", "_last", "_mid", "_stretch", "_len", "_kept")


def _kept(marked: DataFrame, keys, d: Dynamics) -> DataFrame:
    """_kept: whether the run isn't discarded. Window aggregates, so there is no join."""
    every = W.partitionBy(*keys)
    fraction, longest = F.avg(F.when(F.col("_mid"), F.col("_s").cast("double"))).over(every), F.coalesce(F.max("_len").over(every), F.lit(0))
    return marked.withColumn("_kept", F.col("_first").isNotNull() & (fraction <= d.max_fraction_skipped) & (longest <= d.max_skipped_frames))


def skipped_stats(rows: DataFrame, keys=KEYS) -> DataFrame:
    """A row for each run: n_rows, and within its edges n_middle, n_skipped, fraction and longest (skipped in a row)."""
    return _marked(positions(rows, keys), keys).groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if("_mid").alias("n_middle"), F.count_if(F.col("_mid") & F.col("_s")).alias("n_skipped"),
        F.avg(F.when(F.col("_mid"), F.col("_s").cast("double"))).alias("fraction"), F.coalesce(F.max("_len"), F.lit(0)).alias("longest"),
    )


def discard_reasons(rows: DataFrame, keys=KEYS, d: Dynamics = Dynamics()) -> DataFrame:
    """skipped_stats with the reason why a run is discarded; null: it isn't."""
    reason = (
        F.when(F.col("n_middle") == 0, "all_skipped")
        .when(F.col("fraction") > d.max_fraction_skipped, "fraction")
        .when(F.col("longest") > d.max_skipped_frames, "consecutive")
    )
    return skipped_stats(rows, keys).withColumn("reason", reason)


def drop_discarded(rows: DataFrame, keys=KEYS, d: Dynamics = Dynamics()) -> DataFrame:
    """rows without those of discarded runs."""
    return _kept(_marked(rows, keys), keys, d).where("_kept").drop(*_MARKS)


def interpolate(rows: DataFrame, keys=KEYS, names=("x", "y", "theta")) -> DataFrame:
    """Skipped and NaN values on the straight line between the nearest values, by place and not by time; before the
    first and after the last value that value."""
    out = rows if "rn" in rows.columns else positions(rows, keys)
    up, down = W.partitionBy(*keys).orderBy("rn"), W.partitionBy(*keys).orderBy(F.desc("rn"))
    known = {n: F.when(measured(n).isNotNull(), F.struct("rn", measured(n).alias("v"))) for n in names}
    out = out.withColumns({f"_p_{n}": F.last(known[n], True).over(up) for n in names}).withColumns({f"_n_{n}": F.last(known[n], True).over(down) for n in names})
    for n in names:
        p, q = F.col(f"_p_{n}"), F.col(f"_n_{n}")
        line = p["v"] + (q["v"] - p["v"]) * (F.col("rn") - p["rn"]) / F.nullif(q["rn"] - p["rn"], F.lit(0))
        out = out.withColumn(n, F.coalesce(line, p["v"], q["v"]))
    return out.drop(*(f"_{k}_{n}" for n in names for k in "pn"))


def cut_at_wall(rows: DataFrame, keys=KEYS, d: Dynamics = Dynamics(), c: Tracking = Tracking()) -> DataFrame:
    """Rows before the first one beyond the arena's outer radius."""
    out = rows if "rn" in rows.columns else positions(rows, keys)
    hit = F.min(F.when(outside(F.col("x"), F.col("y"), d, c), F.col("rn"))).over(W.partitionBy(*keys))
    return out.withColumn("_hit", hit).where(F.col("_hit").isNull() | (F.col("rn") < F.col("_hit"))).drop("_hit")


def clean(rows: DataFrame, keys=KEYS, d: Dynamics = Dynamics(), c: Tracking = Tracking()) -> DataFrame:
    """trim, discard, interpolate, cut at the wall. Runs that lose all rows are gone."""
    return cut_at_wall(interpolate(drop_discarded(trim_edges(rows, keys), keys, d), keys), keys, d, c)


def observed_clean(rows: DataFrame, keys=KEYS, d: Dynamics = Dynamics(), c: Tracking = Tracking()) -> tuple[DataFrame, dict[str, Observation]]:
    """clean() with the number of rows at each step, which Spark counts as the rows pass: they are there after whatever action
    writes or reads the result whole, at no pass of their own."""
    seen = {name: Observation(f"clean_{name}") for name in ("raw", "trimmed", "kept", "clean")}

    def noted(df: DataFrame, name: str) -> DataFrame:
        return df.observe(seen[name], F.count(F.lit(1)).alias("rows"))

    out = noted(trim_edges(noted(rows, "raw"), keys), "trimmed")
    out = noted(drop_discarded(out, keys, d), "kept")
    return noted(cut_at_wall(interpolate(out, keys), keys, d, c), "clean"), seen


def clean_counts(rows: DataFrame, keys=KEYS, d: Dynamics = Dynamics(), c: Tracking = Tracking()) -> DataFrame:
    """Rows of each run before, after trimming and after cleaning (0: discarded or emptied), in one pass with flags in place of filters."""
    every = W.partitionBy(*keys)
    out = _kept(_marked(positions(rows, keys), keys), keys, d)
    out = out.withColumn("_raw", F.count("*").over(every)).withColumn("_trimmed", F.count_if("_mid").over(every))
    out = interpolate(out.where("_mid OR rn = 0"), keys)  # rows outside of the edges are skipped ones, which no value comes from
    hit = F.min(F.when(F.col("_mid") & outside(F.col("x"), F.col("y"), d, c), F.col("rn"))).over(every)
    left = F.col("_mid") & F.col("_kept") & (F.col("_hit").isNull() | (F.col("rn") < F.col("_hit")))
    return out.withColumn("_hit", hit).groupBy(*keys).agg(F.first("_raw").alias("n_raw"), F.first("_trimmed").alias("n_trimmed"), F.count_if(left).alias("n_clean"))
