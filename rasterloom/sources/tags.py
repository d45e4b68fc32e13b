"""What image files say about themselves: orientation and colour profile, read from their bytes.

Orientation is tag 0x0112 of the first EXIF directory (in a JPEG's APP1 segment or
a PNG's eXIf chunk).  A PNG's profile is read if it gives RGB by a matrix and one
curve for each channel; other profiles, and damaged ones, count as sRGB.  Spark's
decoder has applied a JPEG's profile already.

Defined cases: files without tags, of other kinds or cut off have orientation 1
and no profile; orientations outside 1 to 8 count as 1.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points of a channel's curve in a parsed profile.
CURVE_POINTS = 1024
TAGS = "origin string, orientation int, profile struct<matrix: array<double>, curves: array<array<double>>>"
#: sRGB's primaries as columns of a matrix to XYZ under D50, fixed values.
SRGB_D50 = np.array([[0.4360747, 0.3850649, 0.1430804], [0.2225045, 0.7168786, 0.0606169], [0.0139322, 0.0971045, 0.7141733]])


def _segments(data: bytes) -> Iterator[tuple[str, bytes]]:
    """A JPEG's application segments ("1" for APP1) or a PNG's chunks by name, up to the pixels."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if kind == 0xFF:  # fill bytes may stand before a marker
                at += 1
                continue
            if kind in (0xD9, 0xDA):
                return
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xE0 <= kind <= 0xEF:
                yield str(kind - 0xE0), data[at + 4 : at + 2 + size]
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
            if name in ("IDAT", "IEND"):
                return
            yield name, data[at + 8 : at + 8 + size]
            at += 12 + size


def _directory_orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    (at,) = struct.unpack_from(f"{order}I", tiff, 4)
    if at + 2 > len(tiff):
        return 1
    (entries,) = struct.unpack_from(f"{order}H", tiff, at)
    for i in range(entries):
        here = at + 2 + 12 * i
        if here + 12 > len(tiff):
            break
        tag, kind = struct.unpack_from(f"{order}HH", tiff, here)
        if tag == 0x0112 and kind == 3:
            (value,) = struct.unpack_from(f"{order}H", tiff, here + 8)
            return value if 1 <= value <= 8 else 1
    return 1


def orientation_of(data: bytes) -> int:
    for name, body in _segments(data):
        if name == "eXIf":
            return _directory_orientation(body)
        if name == "1" and body[:6] == b"Exif\0\0":
            return _directory_orientation(body[6:])
    return 1


def _profile_bytes(data: bytes) -> bytes | None:
    for name, body in _segments(data):
        if name == "iCCP":
            try:
                return zlib.decompress(body[body.find(b"\0") + 2 :])
            except zlib.error:
                return None
    return None


def _curve(body: bytes) -> np.ndarray | None:
    """A channel's light at evenly spaced values."""
    x = np.linspace(0, 1, CURVE_POINTS)
    if body[:4] == b"curv" and len(body) >= 12:
        (n,) = struct.unpack_from(">I", body, 8)
        if n == 0:
            return x
        if len(body) < 12 + 2 * n:
            return None
        table = np.frombuffer(body, ">u2", n, 12)
        return x ** (table[0] / 256.0) if n == 1 else np.interp(x, np.linspace(0, 1, n), table / 65535.0)
    if body[:4] == b"para" and len(body) >= 12:
        (kind,) = struct.unpack_from(">H", body, 8)
        n = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}.get(kind)
        if n is None or len(body) < 12 + 4 * n:
            return None
        g, a, b, c, d, e, f = [v / 65536.0 for v in struct.unpack_from(f">{n}i", body, 12)] + [0.0] * (7 - n)
        if kind == 0:
            return x**g
        bent = np.maximum(0.0, a * x + b) ** g
        low = {1: (-b / a if a else 0.0, 0.0, 0.0), 2: (-b / a if a else 0.0, c, c), 3: (d, 0.0, c * x), 4: (d, e, c * x + f)}[kind]
        return np.clip(np.where(x >= low[0], bent + low[1], low[2]), 0.0, 1.0)
    return None


def profile_of(data: bytes) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """The matrix from light to XYZ under D50 and the channels' curves of a PNG's matrix profile."""
    icc = _profile_bytes(data)
    if icc is None or len(icc) < 132 or icc[16:20] != b"RGB " or icc[36:40] != b"acsp":
        return None
    tags = {}
    (count,) = struct.unpack_from(">I", icc, 128)
    for i in range(min(count, (len(icc) - 132) // 12)):
        name, at, size = struct.unpack_from(">4sII", icc, 132 + 12 * i)
        tags[name.decode("latin-1")] = icc[at : at + size]
    if "A2B0" in tags or any(f"{c}{kind}" not in tags for c in "rgb" for kind in ("XYZ", "TRC")):
        return None
    if any(len(tags[f"{c}XYZ"]) < 20 for c in "rgb"):
        return None
    matrix = np.array([[v / 65536.0 for v in struct.unpack_from(">3i", tags[f"{c}XYZ"], 8)] for c in "rgb"]).T
    curves = [_curve(tags[f"{c}TRC"]) for c in "rgb"]
    return None if any(c is None for c in curves) else (matrix, curves)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """origin, orientation and profile of the files below ``path`` that have any but the usual ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for name, data in zip(files["path"], files["content"]):
                turn, found = orientation_of(bytes(data)), profile_of(bytes(data))
                if turn != 1 or found:
                    rows.append((name, turn, found and {"matrix": found[0].ravel().tolist(), "curves": [c.tolist() for c in found[1]]}))
            yield pd.DataFrame(rows, columns=["origin", "orientation", "profile"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, TAGS)


def file_key(column: str):
    """A file's name, whichever of Spark's sources gives it: one slash or three behind the scheme."""
    return F.regexp_replace(column, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image turned and mirrored as its orientation asks for."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image


def to_srgb(rgb: np.ndarray, matrix: np.ndarray, curves: list[np.ndarray]) -> np.ndarray:
    """Channels of 0 to 255 under a profile as sRGB."""
    light = np.stack([np.interp(rgb[..., i] / 255.0, np.linspace(0, 1, len(c)), c) for i, c in enumerate(curves)], -1)
    own = np.clip(light @ np.asarray(matrix).reshape(3, 3).T @ np.linalg.inv(SRGB_D50).T, 0.0, 1.0)
    return 255.0 * np.where(own <= 0.0031308, 12.92 * own, 1.055 * own ** (1 / 2.4) - 0.055)
