"""Tables, reports and images as files."""

from __future__ import annotations

import struct
import zlib
from html import escape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the CSV tables, fixed values, with the decimals of their fractions.
TABLES = {
    "palette": (("palette_index", "number", "hex", "red", "green", "blue", "lab_l", "lab_a", "lab_b", "pixels_before", "pixels_after"), 4),
    "regions": (("region_id", "palette_index", "pixel_count", "pixel_percent", "area_mm2", "min_x", "min_y", "max_x", "max_y", "width", "height", "centroid_x", "centroid_y", "max_thickness_mm", "aspect_ratio", "compactness", "is_below_area_threshold", "is_thin"), 6),
    "adjacency": (("region_a", "region_b", "boundary_pixels", "palette_a", "palette_b", "delta_e76"), 5),
    "merges": (("step", "source_region", "target_region", "source_palette_index", "target_palette_index", "source_pixels", "shared_boundary_pixels", "delta_e76", "forced_by_tolerance"), 5),
    "labels": (("region_id", "palette_index", "number", "status", "reason", "x_px", "y_px", "clearance_mm", "font_size_mm"), 5),
    "strategies": (("strategy", "regions_before", "regions_after", "merges", "forced_merges", "below_threshold_after", "thin_regions_after", "recolored_pixel_percent", "duration_ms"), 6),
}


def write_table(df: DataFrame, path: str, kind: str, overwrite: bool = False) -> None:
    """One of ``TABLES`` as CSV with a header; absent columns and, unless ``overwrite``, a path that is not empty are refused."""
    columns, digits = TABLES[kind]
    held = dict(df.dtypes)
    if absent := [c for c in columns if c not in held]:
        raise ValueError(f"{kind} lacks {', '.join(absent)}")
    shown = [F.round(c, digits).alias(c) if held[c] in ("double", "float") else F.col(c) for c in columns]
    keys = [c for c in ("image_id",) if c in held]
    df.select(*keys, *shown).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def write_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Nested reports as JSON lines."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def png(image: np.ndarray) -> bytes:
    """An 8-bit gray (H, W) or RGB (H, W, 3) image as PNG."""
    height, width = image.shape[:2]
    rows = np.ascontiguousarray(image, np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


class Page(NamedTuple):
    """A PDF page: an image, where it lies (left, top, width, height in millimetres; the whole page if None) and numbers (x, y, size, text)."""

    image: np.ndarray
    box: tuple[float, float, float, float] | None = None
    numbers: tuple[tuple[float, float, float, str], ...] = ()


def pdf(pages: list[np.ndarray | Page], width_mm: float, height_mm: float) -> bytes:
    """RGB page images as a PDF, with numbers as text; x, y are a number's middle, from the page's upper left."""
    points = lambda mm: mm / 25.4 * 72
    w, h = points(width_mm), points(height_mm)
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for page in pages:
        image, box, numbers = page if isinstance(page, Page) else Page(page)
        left, top, wide, high = map(points, box or (0.0, 0.0, width_mm, height_mm))
        lines = [f"q {wide:.3f} 0 0 {high:.3f} {left:.3f} {h - top - high:.3f} cm /I Do Q"]
        for x, y, size, text in numbers:
            # digits of this font are 0.556 wide and 0.7 high
            s = points(size)
            lines.append(f"BT 0.13 g /F {s:.3f} Tf {points(x) - 0.278 * s * len(text):.3f} {h - points(y) - 0.35 * s:.3f} Td ({text}) Tj ET")
        data, content = zlib.compress(np.ascontiguousarray(image, np.uint8).tobytes()), "\n".join(lines).encode()
        n = len(objects) + 1
        kids.append(f"{n + 2} 0 R")
        objects.append(f"<< /Type /XObject /Subtype /Image /Width {image.shape[1]} /Height {image.shape[0]} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream")
        objects.append(f"<< /Length {len(content)} >>\nstream\n".encode() + content + b"\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:.3f} {h:.3f}] /Contents {n + 1} 0 R /Resources << /XObject << /I {n} 0 R >> /Font << /F 3 0 R >> >> >>".encode())
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return bytes(out) + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


#: The bars of a digit: top, upper left, upper right, middle, lower left, lower right, bottom.
_BARS = {"0": "1110111", "1": "0010010", "2": "1011101", "3": "1011011", "4": "0111010", "5": "1101011", "6": "1101111", "7": "1010010", "8": "1111111", "9": "1111011"}


def _digit(text: str, wide: int, high: int, bar: int) -> np.ndarray:
    out = np.zeros((high, wide), bool)
    middle, on = (high - bar) // 2, [b == "1" for b in _BARS[text]]
    for lit, rows, columns in (
        (on[0], slice(0, bar), slice(None)), (on[1], slice(0, middle + bar), slice(0, bar)), (on[2], slice(0, middle + bar), slice(wide - bar, wide)), (on[3], slice(middle, middle + bar), slice(None)),
        (on[4], slice(middle, high), slice(0, bar)), (on[5], slice(middle, high), slice(wide - bar, wide)), (on[6], slice(high - bar, high), slice(None)),
    ):
        out[rows, columns] |= lit
    return out


def number_mask(number: str, size: float) -> np.ndarray:
    """A number drawn with bars, about as high as ``size`` pixels are for a font, no less than five."""
    high = max(5, round(0.72 * size))
    bar = max(1, high // 7)
    wide, gap = max(3, round(0.6 * high)), max(1, bar)
    parts = [_digit(c, wide, high, bar) for c in number]
    return np.concatenate([p for part in parts for p in (np.zeros((high, gap), bool), part)][1:], axis=1)


def draw_numbers(image: np.ndarray, numbers: list[tuple[float, float, float, str]], ink: int = 34) -> np.ndarray:
    """The image with numbers (x, y, size, text in pixels), each around its middle and cut off at the border."""
    out = image.copy()
    for x, y, size, text in numbers:
        drawn = number_mask(text, size)
        top, left = round(y - drawn.shape[0] / 2), round(x - drawn.shape[1] / 2)
        rows, columns = np.nonzero(drawn)
        rows, columns = rows + top, columns + left
        inside = (rows >= 0) & (rows < out.shape[0]) & (columns >= 0) & (columns < out.shape[1])
        out[rows[inside], columns[inside]] = ink
    return out


def encode_png(pixels: DataFrame) -> DataFrame:
    """image_id and the PNG of every image of a pixel table (columns r, g, b)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        image = np.full((int(group["y"].max()) + 1, int(group["x"].max()) + 1, 3), 255, np.uint8)
        image[group["y"], group["x"]] = group[["r", "g", "b"]]
        return pd.DataFrame({"image_id": [group["image_id"].iloc[0]], "png": [png(image)]})

    kind = dict(pixels.dtypes)["image_id"]
    return pixels.select("image_id", "x", "y", "r", "g", "b").groupBy("image_id").applyInPandas(run, f"image_id {kind}, png binary")


def data_url(column, mime: str):
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(column))


def svg_sheet(width_mm: float, height_mm: float, title: str, paths: list[tuple[str, str, float]], labels: list[tuple[float, float, float, str]]) -> str:
    """A sheet of paths (data, colour, width) and numbers (x, y, size, text) in millimetres."""
    lines = [f'<path d="{d}" fill="none" stroke="{colour}" stroke-width="{w:g}"/>' for d, colour, w in paths]
    marks = [f'<text x="{x:.3f}" y="{y:.3f}" font-size="{s:.3f}" text-anchor="middle" dominant-baseline="central">{escape(t)}</text>' for x, y, s, t in labels]
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width_mm:g}mm" height="{height_mm:g}mm" viewBox="0 0 {width_mm:g} {height_mm:g}">'
    return "\n".join([head, f"<title>{escape(title)}</title>", *lines, *marks, "</svg>"])
