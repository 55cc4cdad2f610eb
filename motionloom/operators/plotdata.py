"""The data behind the figures; nothing is drawn here."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Tracking
from ..functions.columns import time_frame, to_px

QUANTITIES = ("omega_fft", "omega_noise", "v_msd", "R", "omega_ucm")


def quantity(physics: DataFrame, name: str, by: tuple[str, ...] = ("pwm",)) -> DataFrame:
    """A quantity against pwm."""
    if name not in QUANTITIES:
        raise ValueError(f"unknown quantity {name}; there are {', '.join(QUANTITIES)}")
    return physics.select(*by, F.col(name).alias("value"))


def colour_scale(curves: DataFrame, by: str = "pwm") -> DataFrame:
    """Least and largest value of `by`, for a scale of colours."""
    return curves.agg(F.min(by).alias("low"), F.max(by).alias("high"))


def grid_cells(names: DataFrame, name: str = "pwm", columns: int = 5) -> DataFrame:
    """Place of each different value in a grid of figures."""
    n = F.row_number().over(W.orderBy(name)) - 1  # as many rows as there are figures
    return names.select(name).distinct().withColumn("_n", n).select(name, F.floor(F.col("_n") / columns).cast("int").alias("row"), (F.col("_n") % columns).alias("column"))


def fitted_line(curve: DataFrame, fit: DataFrame, keys=("run_id",)) -> DataFrame:
    """The fitted line at the lags of the fit."""
    return curve.join(fit, list(keys)).where("tau <= n_fit").select(*keys, "tau", "tau2", "msd", (F.col("intercept") + F.col("slope") * F.col("tau2")).alias("line"))


def circle_polyline(circles: DataFrame, points: int = 100, keys=("run_id",)) -> DataFrame:
    """(keys, p, x, y): points around (xc, yc) at R, the first again at the end."""
    turn = F.col("p") * (2 * math.pi / (points - 1))
    out = circles.where("R IS NOT NULL").select(*keys, "xc", "yc", "R", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("p"))
    return out.select(*keys, "p", (F.col("xc") + F.col("R") * F.cos(turn)).alias("x"), (F.col("yc") + F.col("R") * F.sin(turn)).alias("y"))


def arrows(detections: DataFrame, length: float, whole: bool = True) -> DataFrame:
    """The end of an arrow along theta; on a frame in whole pixels."""
    turn = F.radians("theta")
    ends = {"x_end": F.col("x") + length * F.cos(turn), "y_end": F.col("y") + length * F.sin(turn)}
    return detections.withColumns({k: v.cast("int") if whole else v for k, v in ends.items()})


def trajectories(tracking: DataFrame, keys=("run_id",), c: Tracking = Tracking()) -> DataFrame:
    """Tracks in frames and pixels, a line for each particle."""
    return tracking.select(*keys, "particle", time_frame(F.col("time"), c).alias("frame"), to_px(F.col("x"), c).alias("x"), to_px(F.col("y"), c).alias("y"))


def axis_limits(width_px: float, height_px: float, c: Tracking = Tracking()) -> tuple[float, float]:
    """Extent of a frame in cm."""
    scale = c.diameter_cm / c.diameter_px
    return width_px * scale, height_px * scale
