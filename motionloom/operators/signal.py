"""Low-pass filter, spectrum and peak frequency of a run's heading."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Dynamics

KEYS = ("run_id",)
#: Samples by which a run is extended at either end before it is filtered.
PAD = 15


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """b, a of a digital low-pass; cutoff as a share of half the sampling rate, between 0 and 1."""
    if not 0 < cutoff < 1:
        raise ValueError("the cutoff must lie between 0 and half the sampling rate")
    warped = 4 * math.tan(math.pi * cutoff / 2)
    analog = -warped * np.exp(1j * math.pi * np.arange(1 - order, order, 2) / (2 * order))
    digital = (4 + analog) / (4 - analog)
    gain = (warped**order / np.prod(4 - analog)).real
    return gain * np.poly(-np.ones(order)), np.poly(digital).real


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The filter's answer from a starting state (transposed form). Plain numbers: arrays of four are slower to make than to use."""
    z, out = start.tolist(), []
    first, rest = float(b[0]), list(zip(range(len(start)), b[1:].tolist(), a[1:].tolist(), strict=True))
    z.append(0.0)
    for v in x.tolist():
        y = first * v + z[0]
        for k, p, q in rest:
            z[k] = z[k + 1] + p * v - q * y
        out.append(y)
    return np.array(out)


def steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state in which a constant 1 gives a constant answer."""
    level = b.sum() / a.sum()
    rest = b[1:] - a[1:] * level
    return np.cumsum(rest[::-1])[::-1]


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over x, which is mirrored through its end points."""
    if len(x) <= PAD:
        raise ValueError(f"more than {PAD} samples are needed")
    long = np.concatenate([2 * x[0] - x[PAD:0:-1], x, 2 * x[-1] - x[-2 : -PAD - 2 : -1]])
    zi = steady(b, a)
    ahead = lfilter(b, a, long, zi * long[0])
    back = lfilter(b, a, ahead[::-1], zi * ahead[-1])[::-1]
    return back[PAD:-PAD]


def peak_omega(theta: np.ndarray, dt: float) -> float | None:
    """Angular frequency of the strongest bin from 1 to n div 2 - 1; the first of several."""
    power = np.abs(np.fft.fft(theta)) ** 2
    n = len(theta)
    if n // 2 < 2:
        return None
    return 2 * math.pi * (int(np.argmax(power[1 : n // 2])) + 1) / (n * dt)


def filtered_omega(time: np.ndarray, theta: np.ndarray, cutoff: float, order: int) -> float | None:
    """omega_fft; None where the run is too short or too coarse, or holds NaN."""
    if len(time) <= PAD or not np.isfinite(theta).all():
        return None
    dt = (time[-1] - time[0]) / (len(time) - 1)
    wn = 2 * cutoff * dt
    if not 0 < wn < 1:
        return None
    return peak_omega(zero_phase(*butterworth(order, wn), np.deg2rad(theta)), dt)


def _omega(keys, cutoff: float, order: int):
    def run(table: pa.Table) -> pa.Table:
        time, theta = table["time"].to_numpy(), table["theta"].to_numpy()
        by = np.argsort(time, kind="stable")
        omega = filtered_omega(time[by], theta[by], cutoff, order)
        return table.select(list(keys)).slice(0, 1).append_column("omega_fft", pa.array([omega], pa.float64()))

    return run


def omega_fft(rows: DataFrame, keys=KEYS, d: Dynamics = Dynamics()) -> DataFrame:
    """(keys, omega_fft): the filter needs a run's rows in order, so this is a kernel for each run."""
    rows = rows.select(*keys, F.col("time").cast("double").alias("time"), F.col("theta").cast("double").alias("theta"))
    schema = rows.select(*keys, F.lit(0.0).cast("double").alias("omega_fft")).schema
    for f in schema:
        f.nullable = True
    return rows.groupBy(*keys).applyInArrow(_omega(keys, d.cutoff, d.order), schema)


def spectrum(rows: DataFrame, value: str = "theta", keys=KEYS) -> DataFrame:
    """(keys, n, dt, k, power) for bins 1 .. n div 2 - 1 of a value in degrees, as radians."""
    n = F.count("*")
    runs = rows.groupBy(*keys).agg(
        n.alias("n"), ((F.max("time") - F.min("time")) / F.nullif(n - 1, F.lit(0))).alias("dt"), F.transform(F.array_sort(F.collect_list(F.struct("rn", F.radians(value).alias("v")))), lambda s: s.v).alias("v")
    )
    bins = runs.where("n >= 4").withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("n") / 2).cast("int") - 1)))
    turn = F.lit(2 * math.pi) * F.col("k") / F.col("n")
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("i"))
    power = F.aggregate("v", start, lambda a, v: F.struct((a.c + v * F.cos(turn * a.i)).alias("c"), (a.s + v * F.sin(turn * a.i)).alias("s"), (a.i + 1).alias("i")), lambda a: a.c * a.c + a.s * a.s)
    return bins.select(*keys, "n", "dt", "k", power.alias("power"))


def _peak(keys, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        time, value, rn = (table[c].to_numpy() for c in ("time", "value", "rn"))
        n = len(time)
        head = table.select(list(keys)).slice(0, 1 if n >= 4 else 0)
        power = np.abs(np.fft.fft(np.deg2rad(value[np.argsort(rn, kind="stable")]))) ** 2
        k = int(np.argmax(power[1 : n // 2])) + 1 if n >= 4 else 0
        dt = (time.max() - time.min()) / max(n - 1, 1)
        omega = 2 * math.pi * k / (n * dt) if dt else None
        for name, x, t in (("k", k, pa.int32()), ("omega", omega, pa.float64())):
            head = head.append_column(name, pa.array([x] * head.num_rows, t))
        return head.cast(schema)

    return run


def spectrum_peak(rows: DataFrame, value: str = "theta", keys=KEYS) -> DataFrame:
    """(keys, k, omega) of the strongest bin of the unfiltered value; the lowest of several. Only the peak leaves the kernel, so a
    run costs n log n and no row for each bin."""
    rows = rows.select(*keys, F.col("time").cast("double").alias("time"), F.col(value).cast("double").alias("value"), "rn")
    schema = rows.select(*keys, F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("omega")).schema
    return rows.groupBy(*keys).applyInArrow(_peak(keys, to_arrow_schema(schema)), schema)
