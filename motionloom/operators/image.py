"""Image operators over pixels as rows: (keys.., i, j, b, g, r), i the row and j the column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Tracking
from ..functions.columns import heading

KEYS = ("video_id", "frame")


def flip(pixels: DataFrame, height: int | Column) -> DataFrame:
    """Upside down."""
    return pixels.withColumn("i", (F.lit(height) - 1 - F.col("i")).cast("int"))


def in_circle(cx: float, cy: float, radius: float) -> Column:
    """The circular mask as a predicate; edge pixels count by distance."""
    return (F.col("i") - cy) * (F.col("i") - cy) + (F.col("j") - cx) * (F.col("j") - cx) <= radius * radius


def mask(pixels: DataFrame, c: Tracking = Tracking()) -> DataFrame:
    return pixels.where(in_circle(*c.center, c.radius))


def subtract(frames: DataFrame, background: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """frame - background by channel, not below 0. background: (keys, i, j, b, g, r), one image for each of keys; Spark
    broadcasts it where it is small enough and shuffles by pixel otherwise."""
    back = background.select(*keys, "i", "j", *(F.col(c).alias(f"_{c}") for c in "bgr"))
    out = frames.join(back, [*keys, "i", "j"])
    return out.withColumns({c: F.greatest(F.col(c) - F.col(f"_{c}"), F.lit(0)) for c in "bgr"}).drop("_b", "_g", "_r")


def gray(pixels: DataFrame) -> DataFrame:
    """gray: the rounded weighted mean of the channels."""
    # The weights of red, green and blue, in thousandths.
    return pixels.withColumn("gray", F.floor((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b") + 500) / 1000).cast("int"))


def binarize(pixels: DataFrame, threshold: int = 2) -> DataFrame:
    """v: 255 where gray is above the threshold, else 0."""
    out = pixels if "gray" in pixels.columns else gray(pixels)
    return out.withColumn("v", F.when(F.col("gray") > threshold, 255).otherwise(0))


def _tiles(side: int, top, left, bottom, right) -> tuple[Column, Column]:
    """Rows and columns of the tiles that a box covers, inclusive."""
    return F.sequence(F.floor(top / side), F.floor(bottom / side)), F.sequence(F.floor(left / side), F.floor(right / side))


def angles(binary: DataFrame, centers: DataFrame, keys=KEYS, radius: int = Tracking.disc) -> DataFrame:
    """(keys, x, y, theta) of each centre (keys, x, y): the heading of the mean white pixel of the disc about it, from
    exact sums; null where the disc has none. White pixels alone travel, and meet centres by tiles as wide as a disc, of
    which a disc covers four at most."""
    side = 2 * radius + 1
    tile = [F.floor(F.col(c) / side).alias(t) for c, t in (("i", "_ti"), ("j", "_tj"))]
    white = binary.where("v > 0").select(*keys, "i", "j", "v", *tile)
    rows, cols = _tiles(side, F.col("y") - radius, F.col("x") - radius, F.col("y") + radius, F.col("x") + radius)
    spots = centers.select(*keys, "x", "y", F.explode(rows).alias("_ti")).select("*", F.explode(cols).alias("_tj"))
    near = (F.col("i") - F.col("y")) * (F.col("i") - F.col("y")) + (F.col("j") - F.col("x")) * (F.col("j") - F.col("x")) <= radius * radius
    sums = white.join(spots, [*keys, "_ti", "_tj"]).where(near).groupBy(*keys, "x", "y").agg(*(F.sum(F.col("v").cast("long") * F.col(c)).alias(f"_{c}") for c in "ij"), F.sum(F.col("v").cast("long")).alias("_v"))
    out = centers.select(*keys, "x", "y").join(sums, [*keys, "x", "y"], "left")
    return out.withColumn("theta", heading(F.col("_i") / F.col("_v") - F.col("y"), F.col("_j") / F.col("_v") - F.col("x"))).drop("_i", "_j", "_v")


def size_filter(contours: DataFrame, areas=Tracking.areas, perimeters=Tracking.perimeters) -> DataFrame:
    """Contours whose area and perimeter lie between the bounds, strictly."""
    return contours.where((F.col("area") > areas[0]) & (F.col("area") < areas[1]) & (F.col("perimeter") > perimeters[0]) & (F.col("perimeter") < perimeters[1]))


def wrong_count(frames: DataFrame, detections: DataFrame, n_bots: int = Tracking.n_bots, keys=KEYS) -> DataFrame:
    """Frames whose number of detections isn't the number of bots."""
    n = detections.groupBy(*keys).agg(F.count("*").alias("n"))
    return frames.select(*keys).join(n, list(keys), "left").fillna(0, ["n"]).where(F.col("n") != n_bots)


def crops(pixels: DataFrame, boxes: DataFrame, keys=KEYS, side: int = 64) -> DataFrame:
    """Pixels within each box (keys, contour, top, left, bottom, right; inclusive), with i and j from its corner. Boxes meet pixels by
    tiles of side x side pixels."""
    rows, cols = _tiles(side, F.col("top"), F.col("left"), F.col("bottom"), F.col("right"))
    tiled = boxes.select("*", F.explode(rows).alias("_ti")).select("*", F.explode(cols).alias("_tj"))
    own = pixels.withColumn("_ti", F.floor(F.col("i") / side)).withColumn("_tj", F.floor(F.col("j") / side))
    out = own.join(tiled, [*keys, "_ti", "_tj"]).where("i BETWEEN top AND bottom AND j BETWEEN left AND right")
    return out.withColumn("i", F.col("i") - F.col("top")).withColumn("j", F.col("j") - F.col("left")).drop("top", "left", "bottom", "right", "_ti", "_tj")
