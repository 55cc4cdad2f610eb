"""Recordings without compression: where each frame lies in a file, and its bytes as an image.

A container's index is read by itself, so a frame costs a read of its own bytes. Kinds: YUV4MPEG2 (.y4m; 4:2:0, 4:2:2, 4:4:4 and mono of
8 bits), AVI with plain blue, green and red or gray pixels (.avi with idx1), and arrays (frames, height, width[, channels]) of
bytes (.npy). A video format with compression needs a decoder, which images.DECODERS takes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyarrow import NativeFile

HEAD = 4096


@dataclass(frozen=True)
class Layout:
    """Shape of a frame as an image, begin and size of each frame in the file, and what makes the image of its bytes."""

    shape: tuple[int, int, int]
    starts: np.ndarray
    size: int
    image: Callable[[bytes], np.ndarray]


def y4m(file: NativeFile) -> Layout:
    head = file.read_at(min(HEAD, file.size()), 0)
    line, ok, _ = head.partition(b"\n")
    tags = {t[:1]: t[1:].decode() for t in line.split(b" ")[1:]}
    if not ok or not line.startswith(b"YUV4MPEG2"):
        raise ValueError("no YUV4MPEG2 header")
    w, h, kind = int(tags[b"W"]), int(tags[b"H"]), tags.get(b"C", "420")
    if "p1" in kind:
        raise ValueError(f"more than 8 bits: {kind}")
    down, across = {"420": (2, 2), "422": (1, 2), "444": (1, 1), "mono": (0, 0)}[kind[:4] if kind == "mono" else kind[:3]]
    ch, cw = (-(-h // down), -(-w // across)) if down else (0, 0)
    size = w * h + 2 * ch * cw
    lead = head[len(line) + 1 :].partition(b"\n")[0]
    if head[len(line) + 1 :] and not lead.startswith(b"FRAME"):
        raise ValueError("no frame after the header")
    step = len(lead) + 1 + size  # frames have the same parameters
    starts = len(line) + 1 + step * np.arange((file.size() - len(line) - 1) // step) + len(lead) + 1

    def image(data: bytes) -> np.ndarray:
        a = np.frombuffer(data, np.uint8)
        y = a[: w * h].reshape(h, w)
        if not down:
            return y[..., None]
        u, v = (a[w * h + k * ch * cw : w * h + (k + 1) * ch * cw].reshape(ch, cw).repeat(down, 0).repeat(across, 1)[:h, :w].astype(np.float32) - 128 for k in (0, 1))
        light = 1.164383 * (y.astype(np.float32) - 16)  # Fixed values: those of the BT.601 recommendation, for levels 16 to 235
        out = np.stack([light + 2.017232 * u, light - 0.391762 * u - 0.812968 * v, light + 1.596027 * v], axis=-1)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)

    return Layout((h, w, 3 if down else 1), starts, size, image)


def avi(file: NativeFile) -> Layout:
    def chunks(at: int, end: int):
        while at + 8 <= end:
            name, n = struct.unpack("<4sI", file.read_at(8, at))
            yield name, at + 8, n
            at += 8 + n + n % 2

    if file.read_at(4, 0) != b"RIFF" or file.read_at(4, 8) != b"AVI ":
        raise ValueError("no AVI header")
    form = index = movie = None
    for name, at, n in chunks(12, min(file.size(), 8 + struct.unpack("<I", file.read_at(4, 4))[0])):
        kind = file.read_at(4, at) if name == b"LIST" else b""
        if kind == b"hdrl":
            for inner, a, m in chunks(at + 4, at + n):
                if inner == b"LIST" and file.read_at(4, a) == b"strl" and form is None:
                    own = {x: file.read_at(min(k, 64), b) for x, b, k in chunks(a + 4, a + m)}
                    form = own[b"strf"] if own[b"strh"][:4] == b"vids" else None
        elif kind == b"movi":
            movie = at
        elif name == b"idx1":
            index = np.frombuffer(file.read_at(n, at), np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]))
    if form is None or index is None or movie is None:
        raise ValueError("an AVI file needs a video stream and an index")
    w, h, _, bits, packing = struct.unpack("<iiHHI", form[4:20])
    if packing or bits not in (8, 24):
        raise ValueError("only AVI files of plain 8 or 24 bit pixels")
    size, channels = (w * bits // 8 + 3) // 4 * 4 * abs(h), bits // 8
    index = index[(index["id"] == b"00db") & (index["n"] == size)]
    # places count from the list's name, or in some writers from the file's begin
    base = movie if len(index) and int(index["at"][0]) < movie else 0

    def image(data: bytes) -> np.ndarray:
        rows = np.frombuffer(data, np.uint8).reshape(abs(h), -1)[:, : w * channels].reshape(abs(h), w, channels)
        return rows[::-1] if h > 0 else rows

    return Layout((abs(h), w, channels), base + index["at"].astype(np.int64) + 8, size, image)


def npy(file: NativeFile) -> Layout:
    head = file.read_at(min(HEAD, file.size()), 0)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("no array header")
    width = 2 if head[6] == 1 else 4
    n = int.from_bytes(head[8 : 8 + width], "little")
    # the header is a dictionary of literals
    import ast

    what = ast.literal_eval(head[8 + width : 8 + width + n].decode("latin1"))
    if np.dtype(what["descr"]) != np.uint8 or what["fortran_order"]:
        raise ValueError("only arrays of bytes in C order")
    many, h, w, c = (*what["shape"], 1)[:4] if len(what["shape"]) == 3 else what["shape"]
    size = h * w * c
    return Layout((h, w, c), 8 + width + n + size * np.arange(many), size, lambda data: np.frombuffer(data, np.uint8).reshape(h, w, c))


LAYOUTS = {".y4m": y4m, ".avi": avi, ".npy": npy}
