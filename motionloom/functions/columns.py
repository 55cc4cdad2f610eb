"""Scalar expressions: units, angles, predicates, names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Dynamics, Tracking


def to_cm(v: Column, c: Tracking = Tracking()) -> Column:
    return v * (c.diameter_cm / c.diameter_px)


def to_px(v: Column, c: Tracking = Tracking()) -> Column:
    return v * (c.diameter_px / c.diameter_cm)


def frame_time(frame: Column, c: Tracking = Tracking()) -> Column:
    return frame / c.fps


def time_frame(time: Column, c: Tracking = Tracking()) -> Column:
    """A frame's number as it comes, not rounded."""
    return time * c.fps


def skipped() -> Column:
    """A row that stands for a frame without detection: x, y and theta are all zero."""
    return (F.col("x") == 0) & (F.col("y") == 0) & (F.col("theta") == 0)


def measured(name: str) -> Column:
    """The value, null in skipped rows and where it is NaN."""
    return F.when(~skipped() & ~F.isnan(F.col(name).cast("double")), F.col(name).cast("double"))


def heading(dy: Column, dx: Column) -> Column:
    return F.atan2(dy, dx) * 180 / F.lit(math.pi)


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def outside(x: Column, y: Column, d: Dynamics = Dynamics(), c: Tracking = Tracking()) -> Column:
    """Whether a position in cm lies beyond the arena's outer radius."""
    return distance(to_px(x, c) - d.center_x, to_px(y, c) - d.center_y) > d.outer_radius


def short_name(pog: Column) -> Column:
    return F.replace(pog, F.lit("pog_"), F.lit(""))


def run_name(pog: Column, pwm: Column, trial: Column) -> Column:
    return F.concat_ws("_", pog, pwm, trial)


def run_key(path: Column) -> list[Column]:
    """pog, pwm and trial of a path whose last name is {pog}_{pwm}_{trial}.csv or .mp4."""
    found = r"([^/]*)_(\d+)_(\d+)\.[A-Za-z0-9]+$"
    pick = [F.regexp_extract(path, found, i) for i in (1, 2, 3)]
    return [pick[0].alias("pog"), pick[1].try_cast("int").alias("pwm"), pick[2].try_cast("int").alias("trial")]


def csv_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.mp4$", ".csv")


def ucm(v: Column, radius: Column) -> Column:
    """v / R; NaN where R is unknown or isn't positive."""
    return F.when(radius.isNull() | F.isnan(radius) | (radius <= 0), F.lit(float("nan"))).otherwise(v / radius)


def speed(slope: Column) -> Column:
    return F.when(slope < 0, 0.0).otherwise(F.sqrt(F.greatest(slope, F.lit(0.0))))
