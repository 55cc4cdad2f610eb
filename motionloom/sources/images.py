"""Frames: image folders through Spark's image source, recordings through a data source of our own, and a sink for images."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..schema import FRAMES
from .containers import LAYOUTS
from .stores import opened


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Frames (video_id, frame, height, width, channels, data) of a folder {video}/{number}.{png,jpg,bmp}."""
    im = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder).select("image.*")
    return im.select(
        F.regexp_extract("origin", r"([^/]+)/[^/]+$", 1).alias("video_id"), F.regexp_extract("origin", r"(\d+)\.[A-Za-z]+$", 1).try_cast("int").alias("frame"),
        "height", "width", F.col("nChannels").alias("channels"), "data",
    )


def read_background(spark: SparkSession, path: str) -> DataFrame:
    """A background image as pixels, upside down as frames are."""
    from ..operators.image import flip

    im = spark.read.format("image").option("dropInvalid", True).load(path).select(F.lit("background").alias("video_id"), F.lit(0).alias("frame"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return flip(to_pixels(im), F.col("height")).select("i", "j", "b", "g", "r")


def read_background_image(spark: SparkSession, path: str) -> DataFrame:
    """A background image as bytes (height, width, channels, data), the way it is stored."""
    im = spark.read.format("image").option("dropInvalid", True).load(path)
    return im.select("image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def _pixels(batches):
    for batch in batches:
        for video, frame, h, w, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a = np.frombuffer(data, np.uint8).reshape(h, w, n)
            b, g, r = (a[..., min(k, n - 1)].ravel().astype(np.int32) for k in range(3))
            i, j = (x.ravel().astype(np.int32) for x in np.mgrid[:h, :w])
            same = lambda v, t, size=h * w: pa.repeat(pa.scalar(v, t), size)
            yield pa.RecordBatch.from_arrays([same(video, pa.string()), same(frame, pa.int32()), same(h, pa.int32()), *(pa.array(x, pa.int32()) for x in (i, j, b, g, r))], names=["video_id", "frame", "height", "i", "j", "b", "g", "r"])


def to_pixels(frames: DataFrame) -> DataFrame:
    """A row for each pixel; one or three channels, in the order blue, green, red."""
    return frames.select("video_id", "frame", "height", "width", "channels", "data").mapInArrow(_pixels, "video_id string, frame int, height int, i int, j int, b int, g int, r int")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class ImageWriter(DataSourceArrowWriter):
    """A task writes its images to a folder of its own, and only when all tasks are done do the files move to their places; a
    task that fails, or is made twice, leaves nothing there. Tasks report their folders, not their files."""

    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator) -> Written:
        own, files = f"{self.folder}/_temporary/{self.job}/{uuid.uuid4().hex}", 0
        store, path = opened(own)
        store.create_dir(path, recursive=True)
        try:
            for batch in iterator:
                for name, h, w, n, data in zip(*(batch.column(c).to_pylist() for c in ("name", "height", "width", "channels", "data")), strict=True):
                    a, colour = np.frombuffer(data, np.uint8).reshape(h, w, n), n >= 3
                    with store.open_output_stream(f"{path}/{name}.{'ppm' if colour else 'pgm'}") as out:
                        out.write(f"P{6 if colour else 5}\n{w} {h}\n255\n".encode() + np.ascontiguousarray(a[..., 2::-1] if colour else a[..., 0]).tobytes())
                    files += 1
        except BaseException:
            store.delete_dir(path)
            raise
        return Written(own, files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.files:
                store, path = opened(m.folder)
                for f in store.get_file_info(fs.FileSelector(path)):
                    store.move(f.path, f"{opened(self.folder)[1]}/{f.base_name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, path = opened(f"{self.folder}/_temporary")
        if store.get_file_info(f"{path}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/{self.job}")
        if store.get_file_info(path).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(path)):
            store.delete_dir(path)


class ImageSink(DataSource):
    """spark.dataSource.register(ImageSink); df.write.format("pixmaps").mode("append").save(folder)"""

    @classmethod
    def name(cls):
        return "pixmaps"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("images are added to a folder; what lies there is never removed")
        return ImageWriter(self.options["path"])


def write_images(images: DataFrame, folder: str) -> None:
    """Writes images (name, height, width, channels, data) as portable pixmap or graymap files {name}.ppm or .pgm: all of them, or none."""
    images.sparkSession.dataSource.register(ImageSink)
    images.select("name", "height", "width", "channels", "data").write.format("pixmaps").mode("append").save(folder)


class Span(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


#: Decoders by file ending: number of frames of a local path, and a function that gives one. A decoder of a video format with compression is put in
#: here by whoever has its library.
DECODERS: dict[str, Callable[[str], tuple[int, Callable[[int], np.ndarray]]]] = {}


class FrameReader(DataSourceReader):
    """Frames of recordings. A filter on video_id leaves other files unopened, bounds of frame and the option `ranges` leave other frames
    unread; the plan is made of the containers' indexes."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("framesPerPartition", 64))
        # "first-last,..": frames of whole recordings, whose names don't end in _number_number
        self.ranges = [tuple(map(int, r.split("-"))) for r in options["ranges"].split(",")] if options.get("ranges") else None
        self.names: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "video_id" and values is not None:
                self.names = values if self.names is None else self.names & values
            elif column == "frame" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            elif not isinstance(f, IsNotNull):  # no column of ours is null
                yield f

    def _files(self) -> list[str]:
        store, path = opened(self.path)
        scheme = self.path[: len(self.path) - len(self.path.split(":", 1)[-1])] if ":" in self.path else ""
        one = store.get_file_info(path)
        found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        prefix = {"": "", "file:": "file://"}.get(scheme, f"{scheme}//")
        return sorted(prefix + f.path for f in found if f.type == fs.FileType.File)

    def partitions(self):
        out = []
        for name in self._files():
            stem, ending = os.path.splitext(name.rpartition("/")[2])
            if (ending not in LAYOUTS and ending not in DECODERS) or (self.names is not None and stem not in self.names):
                continue
            n = frames_in(name, ending)
            whole = not re.search(r"_\d+_\d+$", stem)
            for first, last in self.ranges if whole and self.ranges is not None else [(0, n)]:
                first, last = max(first, self.low), min(last, n, n if self.high is None else self.high)
                out += [Span(name, k, min(last, k + self.step)) for k in range(first, last, self.step)]
        return out

    def read(self, partition):
        stem, ending = os.path.splitext(partition.path.rpartition("/")[2])
        if ending in DECODERS:
            _, frame = DECODERS[ending](opened(partition.path)[1])
            for k in range(partition.first, partition.last):
                a = np.ascontiguousarray(frame(k))
                yield stem, k, a.shape[0], a.shape[1], a.shape[2] if a.ndim == 3 else 1, a.tobytes()
            return
        store, path = opened(partition.path)
        with store.open_input_file(path) as file:
            layout = LAYOUTS[ending](file)
            for k in range(partition.first, partition.last):
                image = layout.image(file.read_at(layout.size, int(layout.starts[k])))
                yield stem, k, *layout.shape, np.ascontiguousarray(image).tobytes()


def frames_in(name: str, ending: str) -> int:
    if ending in DECODERS:
        return DECODERS[ending](opened(name)[1])[0]
    store, path = opened(name)
    with store.open_input_file(path) as file:
        return len(LAYOUTS[ending](file).starts)


class FrameSource(DataSource):
    """The format of read_frames()."""

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return FrameReader(self.options)


def read_frames(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None = None, step: int = 64) -> DataFrame:
    """Frames of the recordings in a folder, `step` of one of them a task; of whole recordings only those in the ranges [first, last), if there are
    any. Spark hands filters to the source, for which the session's setting is put on."""
    spark.dataSource.register(FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("frames").option("framesPerPartition", step)
    return (reader.option("ranges", ",".join(f"{a}-{b}" for a, b in ranges)) if ranges is not None else reader).load(path)
