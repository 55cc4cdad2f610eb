"""The registered queries of the motion operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import Dynamics, Tracking
from ..functions import columns as C
from ..operators import circle, cleaning, contours, frames, image, kinematics, linking, plotdata, runs, signal
from . import fixtures as X
from . import pipeline as verbs

#: Clips short enough for the runs of the fixture, which last 2 to 4 seconds.
CLIPS = Dynamics(run_duration=0.5, pause_duration=0.125, start_time=0.25, pwm=(30, 40), trials=2)
#: The grid of the fixture's runs.
TENS = Dynamics(pwm=(30, 40, 50, 60, 70, 80, 90, 100, 110))
KEYS = ("run_id",)
FRAME = ("run_id", "frame")
#: Bounds that fit the small images.
SMALL = Tracking(threshold=12, areas=(30, 90), perimeters=(20, 80), center=(8, 8), radius=9, disc=6, max_offset=3)

#: Bounds that fit the shapes; halos are too large for the first ones.
RANKS = Tracking(threshold=20, max_offset=6, areas=(15, 60), perimeters=(8, 40), fallback_area=(15, 150), fallback_perimeters=(8, 60), disc=5, n_bots=2)
#: The same in an arena that holds all of them; steps are short.
TWO = replace(RANKS, center=(16, 8), radius=40, search_range=8)
SHORT = "run_id % 3 <> 0 OR rn < 12 + run_id % 20"


def _clean(s, d):
    return cleaning.clean(X.tracking(s, d))


def _r(df, *names):
    """Doubles to six places, for comparison."""
    return df.select(*names, *(F.round(c, 6).alias(c) for c, t in df.dtypes if t == "double" and c not in names))


def convert_units(s, d):
    return _r(X.tracking(s, d), "run_id", "frame")


def px_roundtrip(s, d):
    t = X.tracking(s, d)
    return t.select("run_id", "frame", F.round(C.to_px(F.col("x")), 6).alias("x_px"), F.round(C.to_px(F.col("y")), 6).alias("y_px"), F.round(C.time_frame(F.col("time")), 6).alias("frame_of_time"))


def skipped_flag(s, d):
    return X.detections(s, d).select("run_id", "frame", C.skipped().alias("skipped"))


def skipped_stats(s, d):
    return _r(cleaning.skipped_stats(X.tracking(s, d)), "run_id", "n_rows", "n_middle", "n_skipped", "longest")


def trim_edges(s, d):
    return _r(cleaning.trim_edges(X.tracking(s, d)), "run_id", "frame", "rn")


def discard_reason(s, d):
    return cleaning.discard_reasons(X.tracking(s, d)).select("run_id", "n_middle", "n_skipped", "longest", "reason")


def interpolate(s, d):
    return _r(cleaning.interpolate(cleaning.trim_edges(X.tracking(s, d))), "run_id", "frame", "rn")


def wall_cut(s, d):
    return _r(cleaning.cut_at_wall(cleaning.interpolate(cleaning.trim_edges(X.tracking(s, d)))), "run_id", "frame", "rn")


def clean(s, d):
    return _r(_clean(s, d), "run_id", "frame", "rn")


def clean_row_counts(s, d):
    return cleaning.clean_counts(X.tracking(s, d))


def link_single(s, d):
    return linking.link_single(X.detections(s, d)).select("run_id", "frame", "x", "y", "particle")


def append_detections(s, d):
    """Skipped frames and detections, one after the other."""
    e = X.detections(s, d)
    return linking.append_detections(e.where(C.skipped()), e.where("x > 1518 AND y <> 0"), e.where(~C.skipped() & ~F.expr("x > 1518 AND y <> 0")))


def candidate_pairs(s, d):
    return linking.candidate_pairs(X.detections(s, d)).select("run_id", "frame", "x", "y", "x2", "y2", F.col("dist2").cast("long").alias("dist2"))


def link_multi(s, d):
    """Four runs at a time as the bots of one video."""
    found = X.detections(s, d).where(~C.skipped()).select(F.floor(F.col("run_id") / 4).alias("video_id"), "run_id", "frame", "x", "y", "theta")
    return linking.link(found, ("video_id",), 200.0)


def skip_placeholder(s, d):
    every = X.detections(s, d)
    return linking.skip_placeholders(every.select("run_id", "frame"), every.where(~C.skipped()))


def track(s, d):
    return _r(verbs.track(X.detections(s, d)), "run_id", "particle")


def mean_dt(s, d):
    return _r(kinematics.mean_step(_clean(s, d)), "run_id", "n")


def diff_time(s, d):
    return _r(kinematics.time_steps(_clean(s, d)).select("run_id", "rn", "dt"), "run_id", "rn")


def unwrap(s, d):
    return _r(kinematics.unwrap(_clean(s, d)).select("run_id", "rn", "theta_u"), "run_id", "rn")


def gradient(s, d):
    return _r(kinematics.gradient(kinematics.unwrap(_clean(s, d))).select("run_id", "rn", "dtheta"), "run_id", "rn")


def omega_noise(s, d):
    return _r(kinematics.omega_noise(_clean(s, d)), "run_id")


def msd_curve(s, d):
    return _r(kinematics.msd_curve(_clean(s, d)).select("run_id", "tau", "tau2", "msd"), "run_id", "tau")


def v_msd(s, d):
    return _r(kinematics.msd_fit(kinematics.msd_curve(_clean(s, d))).select("run_id", "n_fit", "v_msd"), "run_id", "n_fit")


def msd_mean_by_pwm(s, d):
    curve = kinematics.msd_curve(_clean(s, d)).join(X.run_keys(s, d), "run_id")
    return _r(kinematics.msd_mean(curve, ["pwm"]), "pwm", "tau", "n_runs", "in_all")


def mid_window(s, d):
    return _r(circle.mid_window(_clean(s, d)).select("run_id", "rn", "t_min", "t_max"), "run_id", "rn")


def circle_residuals(s, d):
    return _r(circle.circle_residuals(circle.mid_window(_clean(s, d))).select("run_id", "rn", "radius", "residual"), "run_id", "rn")


def circle_kasa(s, d):
    k = circle.circle_kasa(circle.mid_window(_clean(s, d)))
    return k.select("run_id", "n", *(F.round(c, 4).alias(c) for c in ("xc", "yc", "radius")))


def circle_fit(s, d):
    """Circles through arcs, to four places: both sides come to rest within a millionth of the least spread."""
    fit = circle.circle_fit(X.arcs(s, d))
    return fit.select("run_id", *(F.round(c, 4).alias(c) for c in ("t_min", "t_max", "xc", "yc", "R")), F.size("x_data").alias("n"))


def circle_fit_walks(s, d):
    """Circles through random walks, where they are badly conditioned."""
    return circle.circle_fit(_clean(s, d)).drop("x_data", "y_data")


def dft_peak(s, d):
    return _r(signal.spectrum_peak(_clean(s, d)), "run_id", "k")


def omega_fft(s, d):
    return _r(signal.omega_fft(_clean(s, d)), "run_id")


def omega_ucm(s, d):
    c = _clean(s, d)
    v = kinematics.msd_fit(kinematics.msd_curve(c)).select("run_id", "v_msd")
    k = circle.circle_kasa(circle.mid_window(c)).select("run_id", "radius")
    return v.join(k, "run_id").select("run_id", F.round(C.ucm(F.col("v_msd"), F.col("radius")), 4).alias("omega_ucm"))


def physics(s, d):
    """All quantities of tracks on circles, to four places."""
    got = verbs.physics(X.arcs(s, d)).join(X.run_keys(s, d), "run_id")
    return got.select("run_id", "pwm", "trial", *(F.round(c, 4).alias(c) for c in ("omega_fft", "omega_noise", "v_msd", "R", "omega_ucm")))


def physics_walks(s, d):
    return verbs.pipeline(X.detections(s, d)).join(X.run_keys(s, d), "run_id")


def physics_core(s, d):
    """physics_walks() without the fitted circle, which is badly conditioned on random walks."""
    return _r(physics_walks(s, d).select("run_id", "pwm", "trial", "omega_fft", "omega_noise", "v_msd"), "run_id", "pwm", "trial")


def physics_reasons(s, d):
    """Which cleaned runs give no physics, and why."""
    return verbs.physics_or_reason(_clean(s, d)).select("run_id", "reason")


def physics_reasons_short(s, d):
    """The same where a third of the runs was cut short."""
    rows = _clean(s, d).where(SHORT)
    return verbs.physics_or_reason(rows).select("run_id", "reason")


def trim(s, d):
    pogs = X.run_keys(s, d).select(F.concat(F.lit("pog_"), F.col("run_id").cast("string")).alias("pog"))
    return _r(verbs.trim(pogs, TENS), "pog", "pwm", "trial", "run_index")


def process(s, d):
    """Recordings of all runs to the tracking of their clips."""
    shots = X.images(s, d).withColumn("video_id", F.concat(F.lit("pog_"), F.col("run_id").cast("string"))).drop("run_id")
    return _r(verbs.process(shots, X.background_images(s, d).limit(1), SMALL, CLIPS, flip=False), "pog", "pwm", "trial", "particle")


def process_two(s, d):
    """Recordings of two bots a frame, some frames without any, to linked tracking of their clips."""
    shots = X.shapes(s, d).withColumn("video_id", F.concat(F.lit("pog_"), F.col("run_id").cast("string"))).drop("run_id")
    return _r(verbs.process(shots, X.shapes_ground(s), TWO, CLIPS, flip=False), "pog", "pwm", "trial", "particle")


def known_pogs(s, d):
    pogs = X.run_keys(s, d).select(F.concat(F.lit("pog_"), F.col("run_id").cast("string")).alias("pog"), "pwm", "trial")
    return runs.known_pogs(pogs, ["pog_0", "pog_3", "pog_7"])


def axis_limits(s, d):
    """The limits in cm of a plot of each run."""
    x, y = plotdata.axis_limits(F.max("x"), F.max("y"))
    return X.detections(s, d).groupBy("run_id").agg(F.round(x, 6).alias("x_cm"), F.round(y, 6).alias("y_cm"))


def experiment_grid(s, d):
    ids = X.run_keys(s, d).select(F.concat(F.lit("pog_"), F.col("run_id").cast("string")).alias("pog"))
    return _r(runs.experiment_grid(ids, TENS), "pog", "pwm", "trial", "run_index")


def assign_runs(s, d):
    out = runs.assign_runs(X.tracking(s, d).select("run_id", "frame", "time"), CLIPS)
    return _r(out.drop("time"), "run_id", "frame", "run_index", "pwm", "trial")


def interval_join(s, d):
    clips = X.run_keys(s, d).select("run_id", (F.col("trial") * 0.25).alias("start"), (F.col("trial") * 0.25 + 0.625).alias("end"))
    out = runs.in_clips(X.tracking(s, d).select("run_id", "frame", "time"), clips, "run_id")
    return _r(out, "run_id", "frame")


def _present(s, d):
    got = runs.assign_runs(X.tracking(s, d), CLIPS)
    return got.select(F.concat(F.lit("pog_"), F.col("run_id").cast("string")).alias("pog"), "pwm", "trial").distinct()


def _clip_grid(s, d):
    return runs.experiment_grid(X.run_keys(s, d).select(F.concat(F.lit("pog_"), F.col("run_id").cast("string")).alias("pog")), Dynamics(pwm=(30, 40, 50), trials=2))


def missing_runs(s, d):
    return runs.missing_runs(_clip_grid(s, d), _present(s, d), ["pog", "pwm", "trial"]).select("pog", "pwm", "trial")


def present_runs(s, d):
    return runs.present_runs(_clip_grid(s, d), _present(s, d), ["pog", "pwm", "trial"]).select("pog", "pwm", "trial")


def run_names(s, d):
    name = C.run_name(F.concat(F.lit("pog_"), F.col("run_id").cast("string")), F.col("pwm"), F.col("trial"))
    paths = X.run_keys(s, d).select("run_id", F.concat(F.lit("/videos/"), name, F.lit(".mp4")).alias("path"))
    return paths.select("run_id", C.csv_path(F.col("path")).alias("csv"), *C.run_key(F.col("path"))).withColumn("short", C.short_name(F.col("pog")))


def frame_set(s, d):
    e = X.detections(s, d)
    return runs.frame_set(e.where("x > 1600").select("frame"), e.where("y > 1700").select("frame"))


def frames_in_set(s, d):
    e = X.detections(s, d)
    return runs.with_frames(e.select("run_id", "frame"), e.groupBy("frame").count().where("count % 2 = 1").select("frame"))


def _small(s, d):
    return image.subtract(image.flip(X.frames(s, d), X.SIDE), image.flip(X.background(s, d), X.SIDE), ("run_id",))


def img_flip_mask_subtract(s, d):
    p = _small(s, d).where(image.in_circle(8, 8, 6))
    return p.groupBy(*FRAME).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "bgr"), F.sum(F.col("b") * F.col("i")).alias("sum_bi"), F.sum(F.col("r") * F.col("j")).alias("sum_rj"))


def img_binarize(s, d):
    p = image.binarize(_small(s, d), 45)
    return p.groupBy(*FRAME).agg(F.sum("gray").alias("sum_gray"), F.count_if(F.col("v") == 255).alias("n_white"))


def img_angle(s, d):
    white = image.binarize(image.subtract(X.frames(s, d), X.background(s, d), ("run_id",)), 12)
    return _r(image.angles(white, X.centers(s, d), FRAME, 6).select(*FRAME, "theta"), *FRAME)


def contour_measures(s, d):
    m = contours.measured(X.polygons(s, d))
    return _r(m.drop("points"), "event_id", "x", "y")


def size_filter(s, d):
    m = image.size_filter(contours.measured(X.polygons(s, d)), (30, 150), (20, 60))
    return m.select("event_id")


def _images(s, d):
    return frames.with_background(X.images(s, d), X.background_images(s, d), ("run_id",))


def _found(s, d):
    return contours.measured(frames.find_contours(_images(s, d), 12, FRAME))


def find_contours(s, d):
    return _found(s, d).withColumn("points", F.to_json("points"))


def contour_stats(s, d):
    """What find_contours() measures, without the chains."""
    return _r(_found(s, d).drop("points"), *FRAME, "contour", "x", "y")


def contour_boxes(s, d):
    return contours.boxes(_found(s, d), FRAME)


def contour_crops(s, d):
    gray = image.gray(image.subtract(X.frames(s, d), X.background(s, d), ("run_id",)))
    cut = image.crops(gray, contour_boxes(s, d), FRAME)
    return cut.groupBy(*FRAME, "contour").agg(F.count("*").alias("n"), F.sum("gray").alias("sum_gray"), F.max("i").alias("height"), F.max("j").alias("width"))


def threshold_fallback(s, d):
    return _r(frames.with_fallback(_images(s, d), SMALL, FRAME, arena=False), *FRAME, "rank", "x", "y")


def _shapes(s, d):
    return frames.with_background(X.shapes(s, d), X.shapes_ground(s))


def fallback_ranks(s, d):
    """Two bots: frames for which the own threshold will do, a higher one, a lower one, wider bounds, and none."""
    return _r(frames.with_fallback(_shapes(s, d), RANKS, FRAME, arena=False), *FRAME, "rank", "x", "y")


def contours_nested(s, d):
    """Several regions of a frame, with holes and what lies in them."""
    return _r(contours.measured(frames.find_contours(_shapes(s, d), 17, FRAME)).drop("points"), *FRAME, "contour", "x", "y")


def debug_views(s, d):
    """Sums over the pictures of the debug view."""
    v = frames.views(_images(s, d), SMALL.threshold, FRAME, SMALL)
    total = lambda c: F.aggregate(F.sequence(F.lit(1), F.length(c), F.lit(2)), F.lit(0).cast("long"), lambda n, k: n + F.conv(F.substring(c, k, 2), 16, 10).cast("long"))
    return v.select(*FRAME, *(total(F.hex(c)).alias(c) for c in ("masked", "difference", "binary")))


def wrong_count(s, d):
    e = X.detections(s, d)
    return image.wrong_count(e, e.where(~C.skipped()), 1, FRAME)


def detect(s, d):
    """Frames and a background for each run to detections, with rows of zeros where there is no disc."""
    return _r(verbs.detect(X.images(s, d), X.background_images(s, d), SMALL, FRAME, ("run_id",)), *FRAME, "x", "y")


def plot_quantity(s, d):
    c = _clean(s, d)
    v = kinematics.msd_fit(kinematics.msd_curve(c)).select("run_id", "v_msd").join(X.run_keys(s, d), "run_id")
    return _r(plotdata.quantity(v, "v_msd", ("run_id", "pwm")), "run_id", "pwm")


def colour_scale(s, d):
    curve = kinematics.msd_curve(_clean(s, d)).join(X.run_keys(s, d), "run_id")
    return plotdata.colour_scale(curve)


def grid_cells(s, d):
    return plotdata.grid_cells(X.run_keys(s, d))


def msd_fit_line(s, d):
    curve = kinematics.msd_curve(_clean(s, d))
    return _r(plotdata.fitted_line(curve, kinematics.msd_fit(curve)).select("run_id", "tau", "line"), "run_id", "tau")


def circle_polyline(s, d):
    k = circle.circle_kasa(circle.mid_window(_clean(s, d))).withColumnRenamed("radius", "R")
    p = plotdata.circle_polyline(k, 12)
    return p.select("run_id", "p", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def arrows(s, d):
    return plotdata.arrows(X.detections(s, d), 40.0).select("run_id", "frame", "x_end", "y_end")


def trajectories(s, d):
    return _r(plotdata.trajectories(verbs.track(X.detections(s, d))), "run_id", "particle")


QUERIES = {
    f.__name__: f
    for f in (
        convert_units, px_roundtrip, skipped_flag, skipped_stats, trim_edges, discard_reason, interpolate, wall_cut, clean, clean_row_counts, link_single, append_detections, candidate_pairs, link_multi,
        skip_placeholder, track, mean_dt, diff_time, unwrap, gradient, omega_noise, msd_curve, v_msd, msd_mean_by_pwm, mid_window, circle_residuals, circle_kasa, circle_fit, circle_fit_walks, dft_peak,
        omega_fft, omega_ucm, physics, physics_walks, physics_core, physics_reasons, physics_reasons_short, trim, process, process_two, known_pogs, axis_limits, experiment_grid, assign_runs, interval_join, missing_runs, present_runs, run_names, frame_set, frames_in_set, img_flip_mask_subtract, img_binarize,
        img_angle, contour_measures, size_filter, find_contours, contour_stats, contour_boxes, contour_crops, threshold_fallback, fallback_ranks, contours_nested, debug_views, wrong_count, detect, plot_quantity, colour_scale, grid_cells,
        msd_fit_line, circle_polyline, arrows, trajectories,
    )
}
