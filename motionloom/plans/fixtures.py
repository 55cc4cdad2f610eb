"""Motion data derived from the given tables: detections, images and polygons from events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import frame_time, to_cm

SIDE = 16


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), (F.row_number().over(w) - 1).alias("frame"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user: whole-number walks round the arena's centre; events of type error are skipped frames."""
    w = W.partitionBy("user_id").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    e = _events(spark, sf_dir).withColumn("xr", 1518 + F.sum(16 * (F.col("k") % 21 - 10)).over(w)).withColumn("yr", 1529 + F.sum(16 * ((F.col("k") * 37) % 21 - 10)).over(w))
    gone = F.col("event_type") == "error"
    theta = (F.col("frame") * 15 + F.col("k")) % 360 - 180
    return e.select(
        F.col("user_id").alias("run_id"), "frame", F.when(gone, 0).otherwise(F.col("xr")).cast("int").alias("x"), F.when(gone, 0).otherwise(F.col("yr")).cast("int").alias("y"),
        F.when(gone, 0).otherwise(theta).cast("double").alias("theta"),
    )


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detections in seconds and cm."""
    d = detections(spark, sf_dir)
    return d.select("run_id", "frame", frame_time(F.col("frame")).alias("time"), to_cm(F.col("x")).alias("x"), to_cm(F.col("y")).alias("y"), "theta")


def run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pwm and trial of each run."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id")).distinct()
    return ids.select("run_id", (30 + 10 * (F.col("run_id") % 9)).cast("int").alias("pwm"), (F.floor(F.col("run_id") / 9) % 10).cast("int").alias("trial"))


def _grid(rows: DataFrame) -> DataFrame:
    cell = F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))
    return rows.withColumn("c", cell).withColumn("i", F.floor(F.col("c") / SIDE).cast("int")).withColumn("j", F.col("c") % SIDE).drop("c")


BACK = {"b": "20 + (i * 7 + j * 13) % 50", "g": "20 + (i * 5 + j * 3) % 50", "r": "20 + (i + j) % 50"}
#: A disc with a notch below its centre.
LIGHT = {"b": "40 + k", "g": "35 + (k * 3) % 50", "r": "30 + (k * 7) % 60"}
INSIDE = "(i - ci) * (i - ci) + (j - cj) * (j - cj) <= 25 AND NOT (i - ci > 1 AND j - cj BETWEEN -1 AND 1)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small image for each event (run_id, frame, i, j, b, g, r): background, and a notched disc unless it is an error. The
    disc changes each channel by another amount."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("run_id"), "frame", "k", "event_type", (7 + F.col("frame") % 3).alias("ci"), (7 + F.col("k") % 3).alias("cj"))
    lit = F.expr(f"event_type <> 'error' AND {INSIDE}")
    p = _grid(e)
    return p.select("run_id", "frame", "i", "j", *((F.expr(BACK[c]) + F.when(lit, F.expr(LIGHT[c])).otherwise(-(F.col("k") % 3))).cast("int").alias(c) for c in "bgr"))


def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each run (run_id, i, j, b, g, r)."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id")).distinct()
    return _grid(ids).select("run_id", "i", "j", *(F.expr(BACK[c]).cast("int").alias(c) for c in "bgr"))


def _back() -> np.ndarray:
    i, j = np.mgrid[:SIDE, :SIDE]
    return np.stack([20 + (i * 7 + j * 13) % 50, 20 + (i * 5 + j * 3) % 50, 20 + (i + j) % 50], axis=-1)


def _images(batches):
    i, j = np.mgrid[:SIDE, :SIDE]
    back = _back()
    for batch in batches:
        frame, k = (batch.column(c).to_numpy() for c in (1, 2))
        seen = np.array(batch.column(3).to_pylist(), object) != "error"
        a, b = i - (7 + frame % 3)[:, None, None], j - (7 + k % 3)[:, None, None]
        lit = seen[:, None, None] & (a * a + b * b <= 25) & ~((a > 1) & (abs(b) <= 1))
        light = np.stack([40 + k, 35 + k * 3 % 50, 30 + k * 7 % 60], axis=-1)
        data = back + np.where(lit[..., None], light[:, None, None, :], -(k % 3)[:, None, None, None])
        one = [pa.repeat(pa.scalar(n, pa.int32()), batch.num_rows) for n in (SIDE, SIDE, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *one, pa.array([x.tobytes() for x in data.astype(np.uint8)], pa.binary())], names=["run_id", "frame", "height", "width", "channels", "data"])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of frames() as bytes (run_id, frame, height, width, channels, data)."""
    e = _events(spark, sf_dir).select(F.col("user_id").cast("long"), F.col("frame").cast("long"), F.col("k").cast("long"), "event_type")
    return e.mapInArrow(_images, "run_id long, frame int, height int, width int, channels int, data binary")


def background_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of background() as bytes."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id")).distinct()
    size = [F.lit(n).alias(c) for n, c in ((SIDE, "height"), (SIDE, "width"), (3, "channels"))]
    return ids.select("run_id", *size, F.lit(_back().astype(np.uint8).tobytes()).alias("data"))


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each frame's disc is (run_id, frame, x, y)."""
    e = _events(spark, sf_dir).where("event_type <> 'error'")
    return e.select(F.col("user_id").alias("run_id"), "frame", (7 + F.col("k") % 3).alias("x"), (7 + F.col("frame") % 3).alias("y"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadrilateral for each event (event_id, points)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    corner = lambda x, y: F.struct(F.expr(x).cast("int").alias("x"), F.expr(y).cast("int").alias("y"))
    return e.select("event_id", F.array(corner("k", "2 * k"), corner("k + 1 + k % 20", "2 * k"), corner("k + 1 + k % 20 + k % 5", "2 * k + 1 + (k * 7) % 15"), corner("k", "2 * k + 1 + (k * 7) % 15")).alias("points"))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean tracks (run_id, frame, rn, time, x, y, theta) on circles, one for each run, a little beside them; most of a turn lies within two seconds."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("run_id"), "frame", "k", (F.col("user_id") * 0.37 + F.col("frame") * 0.11).alias("a"))
    x = 70 + F.col("run_id") % 11 + (8 + F.col("run_id") % 7) * F.cos("a") + ((F.col("k") * 7) % 11 - 5) * 0.01
    y = 75 - F.col("run_id") % 5 + (8 + F.col("run_id") % 7) * F.sin("a") + ((F.col("k") * 3) % 13 - 6) * 0.01
    turn = F.degrees("a") + 270
    return e.select("run_id", "frame", F.col("frame").alias("rn"), frame_time(F.col("frame")).alias("time"), x.alias("x"), y.alias("y"), (turn - 360 * F.floor(turn / 360) - 180).alias("theta"))


WIDE = 2 * SIDE


def _shapes(batches):
    i, j = np.mgrid[:SIDE, :WIDE]
    for batch in batches:
        frame, k = (batch.column(c).to_numpy()[:, None, None] for c in (1, 2))
        seen = np.array(batch.column(3).to_pylist(), object)[:, None, None] != "error"
        left = (i - (7 + frame % 3)) ** 2 + (j - (7 + k % 3)) ** 2
        right = (i - (7 + k % 3)) ** 2 + (j - (23 + frame % 2)) ** 2
        halo = np.where(k % 7 == 3, 0, 15 + k % 16)
        core = np.where(k % 7 == 3, 14 + k % 10, halo + 10)
        ring = k % 5 == 0
        level = np.where(left <= np.where(ring, 1, 9), core, np.where(left <= 36, halo, 0))
        level = np.where(ring & (left > 1) & (left <= 9), 0, level)
        data = 10 + np.where(seen, np.where(right <= 16, 40, level), 0)
        one = [pa.repeat(pa.scalar(n, pa.int32()), batch.num_rows) for n in (SIDE, WIDE, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *one, pa.array([x.tobytes() for x in data.astype(np.uint8)], pa.binary())], names=["run_id", "frame", "height", "width", "channels", "data"])


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of one channel for each event (run_id, frame, height, width, channels, data), over a ground of 10: on the left a core in a halo, or a
    ring in whose hole an island lies, both of levels that differ from event to event; on the right a disc. Errors are empty."""
    e = _events(spark, sf_dir).select(F.col("user_id").cast("long"), F.col("frame").cast("long"), F.col("k").cast("long"), "event_type")
    return e.mapInArrow(_shapes, "run_id long, frame int, height int, width int, channels int, data binary")


def shapes_ground(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*(F.lit(n).alias(c) for n, c in ((SIDE, "height"), (WIDE, "width"), (1, "channels"))), F.lit(bytes([10] * SIDE * WIDE)).alias("data"))
