"""The verbs: detect, link, convert, clean, extract, plot data, and all of them in turn."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Dynamics, Tracking
from ..functions.columns import run_key, ucm
from ..operators import circle, cleaning, frames, image, linking, plotdata, runs, signal

KEYS = ("run_id",)


def detect(images: DataFrame, background: DataFrame, c: Tracking = Tracking(), keys=image.KEYS, on: tuple[str, ...] = (), flip: bool = False) -> DataFrame:
    """Detections (keys, x, y, theta) of frames as bytes (keys, height, width, channels, data), in one pass. A frame for which no candidate
    gives the right number is a row of zeros. background: one image, or one for each of the keys `on`. Both are upright, or with `flip` both are turned over."""
    return frames.detections(frames.with_background(images, background, on), c, keys, flip)


def track(detections: DataFrame, c: Tracking = Tracking(), keys=KEYS) -> DataFrame:
    """Linked detections in seconds and cm."""
    linked = linking.link_single(detections, keys, c.search_range) if c.n_bots == 1 else linking.link(detections, keys, c.search_range)
    return linking.to_tracking(linked, keys, c)


def observables(time: np.ndarray, x: np.ndarray, y: np.ndarray, theta: np.ndarray, d: Dynamics) -> tuple[float, ...] | str:
    """omega_fft, omega_noise, v_msd and R of one run in order, or the reason why it doesn't give all of them."""
    n = len(time)
    if not (np.isfinite(x).all() and np.isfinite(y).all() and np.isfinite(theta).all()):
        return "not_finite"
    if n <= signal.PAD:
        return "too_short"
    fft = signal.filtered_omega(time, theta, d.cutoff, d.order)
    if fft is None:
        return "too_coarse"
    dt = (time[-1] - time[0]) / (n - 1)
    taus = np.arange(1, min(int(d.max_tau_seconds / dt), n))
    fit = int(d.taus_percentage * len(taus))
    if not fit:
        return "no_lags"
    msd = np.array([((x[t:] - x[:-t]) ** 2 + (y[t:] - y[:-t]) ** 2).mean() for t in taus[:fit]])
    lag2 = (taus[:fit] * dt) ** 2
    slope = ((lag2 - lag2.mean()) * (msd - msd.mean())).sum() / ((lag2 - lag2.mean()) ** 2).sum() if fit > 1 else 0.0
    middle = time[n // 2]
    near = (time >= middle - d.t_subset) & (time <= middle + d.t_subset)
    noise = abs(np.gradient(np.unwrap(np.deg2rad(theta)), time).mean())
    return fft, float(noise), float(np.sqrt(max(slope, 0.0))), circle.fit_circle(x[near], y[near])[2]


QUANTITIES = ("omega_fft", "omega_noise", "v_msd", "R")


def _observe(keys, d: Dynamics, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        time, x, y, theta = (table[c].to_numpy() for c in ("time", "x", "y", "theta"))
        by = np.argsort(time, kind="stable")
        got = observables(time[by], x[by], y[by], theta[by], d)
        failed = isinstance(got, str)
        head = table.select(list(keys)).slice(0, 1)
        for k, name in enumerate(QUANTITIES):
            head = head.append_column(name, pa.array([None if failed else got[k]], pa.float64()))
        return head.append_column("reason", pa.array([got if failed else None], pa.string())).cast(schema)

    return run


def physics_or_reason(clean: DataFrame, keys=KEYS, d: Dynamics = Dynamics()) -> DataFrame:
    """(keys, omega_fft, omega_noise, v_msd, R, omega_ucm, reason) for each run; a run that doesn't give all of them has nulls and
    the reason: not_finite, too_short, too_coarse or no_lags. Filter and fit need a kernel anyway, so all five come from
    one pass over a run's rows, which cleaning has dealt out by run already: no join and no further exchange."""
    rows = clean.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("time", "x", "y", "theta")))
    none = F.lit(None).cast("double")
    schema = rows.select(*keys, *(none.alias(c) for c in QUANTITIES), F.lit(None).cast("string").alias("reason")).schema
    out = rows.groupBy(*keys).applyInArrow(_observe(keys, d, to_arrow_schema(schema)), schema)
    return out.select(*keys, *QUANTITIES, F.when(F.col("reason").isNull(), ucm(F.col("v_msd"), F.col("R"))).alias("omega_ucm"), "reason")


def physics(clean: DataFrame, keys=KEYS, d: Dynamics = Dynamics()) -> DataFrame:
    """(keys, omega_fft, omega_noise, v_msd, R, omega_ucm) for each run that gives all of them."""
    return physics_or_reason(clean, keys, d).where("reason IS NULL").drop("reason")


def pipeline(detections: DataFrame, keys=KEYS, c: Tracking = Tracking(), d: Dynamics = Dynamics()) -> DataFrame:
    """Detections to physics."""
    return physics(cleaning.clean(track(detections, c, keys), keys, d, c), keys, d)


def trim(recordings: DataFrame, d: Dynamics = Dynamics()) -> DataFrame:
    """The clips of recordings (pog, path): a row for each run of the grid with start and end of its clip."""
    return runs.clips(recordings, d)


def process(images: DataFrame, background: DataFrame, c: Tracking = Tracking(), d: Dynamics = Dynamics(), flip: bool = True) -> DataFrame:
    """Tracking (pog, pwm, trial, time, ..) of recordings as frames (video_id, frame, height, width, channels, data). A video_id
    {pog}_{pwm}_{trial} is a clip; any other is a whole recording, whose frames meet the grid's clips by their time."""
    key = run_key(F.concat("video_id", F.lit(".mp4")))
    named = images.select("*", *key)
    single = named.where("pwm IS NOT NULL")
    whole = runs.clip_frames(named.where("pwm IS NULL").drop("pwm", "trial").withColumn("pog", F.col("video_id")), d, c.fps)
    rows = single.unionByName(whole.select(single.columns)).select("pog", "pwm", "trial", "frame", *frames.IMAGE)
    found = detect(rows, background, c, ("pog", "pwm", "trial", "frame"), flip=flip)
    return track(found, c, ("pog", "pwm", "trial"))


def check(grid: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Runs of the grid without data."""
    return runs.missing_runs(grid, present, on)


def plot_data(table: DataFrame, d: Dynamics) -> dict[str, DataFrame]:
    """A table for each quantity that is configured for plotting."""
    return {name: plotdata.quantity(table, name) for name in d.plotting}
