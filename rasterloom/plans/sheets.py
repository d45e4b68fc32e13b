"""From images to colour-by-number sheets: the operators put together.

Images are independent and bounded (``max_side``), so the sequential steps run
one image per task; palettes, tables and reports are DataFrames.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import asdict, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from rasterloom.functions.sheet import LEAST, PAGES_MM, SCALES
from rasterloom.operators import kernels as k
from rasterloom.plans.config import Config
from rasterloom.sources import sinks



def _struct(**fields: type) -> StructType:
    kinds = {int: LongType(), float: DoubleType(), bool: BooleanType(), str: StringType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in fields.items()])


_MERGE = _struct(step=int, source_region=int, target_region=int, source_palette_index=int, target_palette_index=int, source_pixels=int, shared_boundary_pixels=int, delta_e76=float, forced_by_tolerance=bool)
_COLOUR = _struct(palette_index=int, hex=str, l=float, a=float, b=float, pixels_before=int, pixels_after=int)
_REGION = _struct(region_id=int, palette_index=int, pixel_count=int, pixel_percent=float, area_mm2=float, min_x=int, min_y=int, max_x=int, max_y=int, width=int, height=int, centroid_x=float, centroid_y=float, max_thickness_mm=float, aspect_ratio=float, compactness=float, is_below_area_threshold=bool, is_thin=bool, is_subject=bool)
_EDGE = _struct(region_a=int, region_b=int, boundary_pixels=int, palette_a=int, palette_b=int, delta_e76=float)
_LABEL = _struct(region_id=int, palette_index=int, number=int, status=str, reason=str, x_px=float, y_px=float, clearance_mm=float, font_size_mm=float)
_RENDERING = _struct(line_width_mm=float, smoothing_iterations=int, min_smooth_area_px=float, simplify_tolerance_px=float)
SHEET = StructType([
    StructField("image_id", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("mm_per_pixel", DoubleType()), StructField("recolored_pixels", LongType()), StructField("line_art_pixels", LongType()),
    StructField("palette", ArrayType(_COLOUR)), StructField("regions_before", ArrayType(_REGION)), StructField("regions", ArrayType(_REGION)), StructField("adjacency_before", ArrayType(_EDGE)), StructField("adjacency", ArrayType(_EDGE)),
    StructField("labels", ArrayType(_LABEL)), StructField("merges", ArrayType(_MERGE)), StructField("rendering", _RENDERING), StructField("region_before", ArrayType(IntegerType())), StructField("region_after", ArrayType(IntegerType())),
    StructField("svg", StringType()), StructField("palette_svg", StringType()), StructField("images", MapType(StringType(), BinaryType())), StructField("pdf", BinaryType()),
])


def lab_image(rgb: np.ndarray) -> np.ndarray:
    """CIELAB (D65) of 8-bit sRGB."""
    from rasterloom.functions.color import DELTA, RGB_TO_XYZ, WHITE

    v = rgb / 255.0
    light = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    t = light @ np.array(RGB_TO_XYZ).T / WHITE
    f = np.where(t > DELTA**3, np.cbrt(t), t / (3 * DELTA**2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def lab_hex(colour: np.ndarray) -> str:
    from rasterloom.functions.color import DELTA, WHITE, XYZ_TO_RGB

    fy = (colour[0] + 16) / 116
    f = np.array([fy + colour[1] / 500, fy, fy - colour[2] / 200])
    xyz = np.array(WHITE) * np.where(f > DELTA, f**3, 3 * DELTA**2 * (f - 4 / 29))
    light = np.clip(np.array(XYZ_TO_RGB) @ xyz, 0, 1)
    channels = np.where(light <= 0.0031308, 12.92 * light, 1.055 * light ** (1 / 2.4) - 0.055)
    return "#%02X%02X%02X" % tuple(int(c) for c in np.rint(channels * 255))


def fit_palette(lab: np.ndarray, colours: int, seed: int, sample: int, rounds: int = 20) -> np.ndarray:
    """Lloyd's iteration on a seeded sample, from spread-out starts; ordered by lightness, a and b."""
    rng = np.random.default_rng(seed)
    points = lab.reshape(-1, 3)
    if len(points) > sample:
        points = points[np.sort(rng.choice(len(points), sample, replace=False))]
    distinct = np.unique(np.round(points, 4), axis=0)
    colours = min(colours, len(distinct))
    centres = distinct[[rng.integers(len(distinct))]]
    while len(centres) < colours:
        far = ((distinct[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, distinct[far.argmax()]])
    for _ in range(rounds):
        near = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        moved = np.array([points[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres[np.lexsort(centres.T[::-1])]


def assign(lab: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((lab - c) ** 2).sum(-1) for c in centres]).argmin(0)


def vote(labels: np.ndarray, superpixels: np.ndarray, colours: int) -> np.ndarray:
    counts = np.zeros((superpixels.max() + 1, colours), int)
    np.add.at(counts, (superpixels.ravel(), labels.ravel()), 1)
    return counts.argmax(1)[superpixels]


def smooth_modes(labels: np.ndarray, radius: int, colours: int) -> np.ndarray:
    """The most frequent class of the square, borders repeated outwards; ties take the lowest class."""
    if radius <= 0:
        return labels
    size, counts = 2 * radius + 1, []
    for c in range(colours):
        total = np.pad((labels == c).astype(int), radius, mode="edge")
        for axis in (0, 1):
            run = np.cumsum(total, axis)
            zero = np.zeros_like(np.take(run, [0], axis))
            run = np.concatenate([zero, run], axis)
            n = total.shape[axis] - size + 1
            total = np.take(run, np.arange(size, size + n), axis) - np.take(run, np.arange(n), axis)
        counts.append(total)
    return np.stack(counts).argmax(0)


def page(config: Config, width: int, height: int, colours: int) -> tuple[float, float, float, float, float]:
    """Page width and height, the scale in millimetres per pixel and the image's origin."""
    page_w, page_h = PAGES_MM[config.page_format]
    if config.orientation == "landscape":
        page_w, page_h = page_h, page_w
    room_w, room_h = page_w - 2 * config.margin_mm, page_h - 2 * config.margin_mm
    if config.palette_layout == "inline":
        room_h -= config.legend_height_mm or 9 + 7 * math.ceil(colours / max(1, int(room_w // 30)))
    if room_w <= 0 or room_h <= 0:
        raise ValueError("the margins leave no room")
    scale = min(room_w / width, room_h / height)
    return page_w, page_h, scale, config.margin_mm + (room_w - width * scale) / 2, config.margin_mm + (room_h - height * scale) / 2


def tuned(config: Config, width: int, height: int) -> Config:
    """The parameters that suit the image's size, where ``auto_tune`` asks for them."""
    if not config.auto_tune:
        return config
    long, pixels = max(width, height), width * height
    kind = "large" if long >= 1400 or pixels >= 1_400_000 else "small" if long <= 900 or pixels <= 600_000 else "medium"
    scale, (smoothing, background, contour, area) = SCALES[kind], LEAST[kind]
    drawn = lambda value, low, high: min(high, max(low, value))
    return replace(
        config, superpixels=int(drawn(round(config.superpixels * scale[0]), 10, 20000)), min_region_area_mm2=drawn(config.min_region_area_mm2 * scale[1], 1, 80), subject_min_region_area_mm2=drawn(config.subject_min_region_area_mm2 * scale[2], 1, 80),
        background_min_region_area_mm2=drawn(config.background_min_region_area_mm2 * scale[3], 1, 120), detail_min_region_area_mm2=drawn(config.detail_min_region_area_mm2 * scale[4], 0.75, 40), smoothing_radius=max(config.smoothing_radius, smoothing),
        background_smoothing_radius=max(config.background_smoothing_radius, background), contour_smoothing_iterations=max(config.contour_smoothing_iterations, contour), min_contour_smooth_area_px=max(config.min_contour_smooth_area_px, area),
    )


def rendering(config: Config, scale: float) -> dict:
    """Line width, smoothing and simplification for the sheet's scale."""
    wide = config.line_width_mm * (1.12 if config.page_format == "a3" else 1.0) + min(0.06, max(0.0, (scale - 0.16) * 0.45))
    rounds = min(3, max(2, config.contour_smoothing_iterations + 1)) if scale >= 0.22 else max(1, config.contour_smoothing_iterations)
    least = max(config.min_contour_smooth_area_px, min(8.0, max(2.5, config.min_region_area_mm2 * 0.4)) / max(scale**2, 1e-9))
    return {"line_width_mm": min(0.42, max(0.18, wide)), "smoothing_iterations": rounds, "min_smooth_area_px": least, "simplify_tolerance_px": config.contour_simplify_mm / max(scale, 1e-9)}


class Segments(NamedTuple):
    """An image before its regions are merged."""

    unit: np.ndarray  # smoothed colours from 0 to 1
    quantised: np.ndarray  # palette index of every pixel by colour alone
    labels: np.ndarray  # and after segmentation
    colours: np.ndarray
    ids: np.ndarray
    classes: dict[int, int]
    least: dict[int, int]
    page: tuple[float, float, float, float, float]


class Merged(NamedTuple):
    ids: np.ndarray
    classes: dict[int, int]
    log: list[k.Merge]


def _segmented(lab: np.ndarray, labels: np.ndarray, config: Config, superpixels: int, radius: int, colours: int) -> np.ndarray:
    if config.segmentation != "components":
        labels = vote(labels, k.slic(lab, superpixels, config.compactness, adaptive=config.segmentation == "slic"), colours)
    return smooth_modes(labels, radius, colours)


def segment(rgb: np.ndarray, config: Config, subject: np.ndarray | None = None, detail: np.ndarray | None = None) -> Segments:
    """Palette, classes and regions of one image; background and subject have their own superpixels and smoothing."""
    height, width = rgb.shape[:2]
    unit = k.bilateral(k.bilateral(rgb / 255.0, config.preprocess_sigma_color, config.preprocess_sigma_spatial / 2), min(0.25, 1.45 * config.preprocess_sigma_color), min(12.0, 1.65 * config.preprocess_sigma_spatial) / 2)
    lab = lab_image(unit * 255.0)
    for channel in (1, 2):
        lab[..., channel] = k.gaussian(lab[..., channel], 0.65)
    parts = [np.ones((height, width), bool)] if subject is None else [subject, ~subject]
    sizes = [config.colors] if subject is None else list(config.split_colors())
    palettes, quantised, first = [], np.zeros((height, width), int), 0
    for part, size in zip(parts, sizes):
        if not part.any():
            continue
        centres = fit_palette(lab[part], size, config.seed, config.sample_pixels)
        own = assign(lab[part], centres)
        centres, new = k.clean_palette(centres, np.bincount(own, minlength=len(centres)), config.palette_merge_delta_e, 2)
        quantised[part] = new[own] + first
        palettes.append(centres)
        first += len(centres)
    colours = np.vstack(palettes)
    fine = _segmented(lab, quantised, config, config.superpixels, config.smoothing_radius, len(colours))
    labels = fine
    if subject is not None or detail is not None:
        coarse = _segmented(lab, quantised, config, max(10, round(config.superpixels * config.background_superpixel_ratio)), config.background_smoothing_radius, len(colours))
        labels = coarse
        if subject is not None:
            # each side keeps to its own palette
            split = len(palettes[0])
            labels = np.where(subject, np.where(fine < split, fine, quantised), np.where(coarse >= split, coarse, quantised))
        if detail is not None:
            labels = np.where(detail, fine, labels)
    ids = k.label_components(labels, np.ones(labels.shape, bool), config.connectivity)
    numbers, at = np.unique(ids, return_index=True)
    classes = dict(zip(numbers.tolist(), labels.ravel()[at].tolist()))
    geometry = page(config, width, height, len(colours))
    pixels_of = lambda area: max(1, math.ceil(area / geometry[2] ** 2))
    least = dict.fromkeys(classes, pixels_of(config.min_region_area_mm2))
    if subject is not None:
        group = groups_of(ids, subject)
        least = {r: pixels_of(config.subject_min_region_area_mm2 if group[r] else config.background_min_region_area_mm2) for r in classes}
    if detail is not None:
        for r in np.unique(ids[detail]).tolist():
            least[r] = min(least[r], pixels_of(config.detail_min_region_area_mm2))
    return Segments(unit, quantised, labels, colours, ids, classes, least, geometry)


def groups_of(ids: np.ndarray, subject: np.ndarray) -> dict[int, int]:
    """1 for regions of which at least half lies in the subject."""
    total, inside = np.bincount(ids.ravel()), np.bincount(ids.ravel(), subject.ravel())
    return {i: int(2 * inside[i] >= total[i]) for i in range(1, len(total))}


def merge(made: Segments, config: Config, strategy: str, subject: np.ndarray | None = None) -> Merged:
    """Small regions merged, then those too narrow for their number."""
    scale = made.page[2]
    ids, classes, log = k.merge_image(made.ids, made.classes, made.least, made.colours, strategy, config.color_tolerance, groups_of(made.ids, subject) if subject is not None else None)
    again = (lambda now: groups_of(now, subject)) if subject is not None else None
    least = max(1, math.ceil(config.min_region_area_mm2 / scale**2))
    ids, classes, more = k.improve_labels(ids, classes, made.colours, scale, least, config.min_region_area_mm2, config.min_number_font_mm, config.number_padding_mm, strategy, config.color_tolerance, again, config.thin_merge_passes)
    return Merged(ids, classes, log + [m._replace(step=len(log) + m.step) for m in more])


def region_rows(ids: np.ndarray, classes: dict[int, int], least_pixels: int, config: Config, scale: float, subject: np.ndarray | None = None, far: np.ndarray | None = None) -> list[dict]:
    """Geometry of every region; ``far`` is each pixel's distance to the outside where it is known."""
    flat, count = ids.ravel(), np.bincount(ids.ravel())
    yy, xx = np.mgrid[: ids.shape[0], : ids.shape[1]]
    low_x, low_y, high_x, high_y = (np.full(len(count), big) for big in (ids.size, ids.size, -1, -1))
    for low, high, place in ((low_x, high_x, xx), (low_y, high_y, yy)):
        np.minimum.at(low, flat, place.ravel())
        np.maximum.at(high, flat, place.ravel())
    cx, cy = (np.bincount(flat, a.ravel()) / np.maximum(1, count) for a in (xx, yy))
    deepest = np.zeros(len(count))
    np.maximum.at(deepest, flat, (k.distance_to_outside(ids) if far is None else far).ravel())
    around = np.bincount(np.concatenate([ids[0], ids[-1], ids[:, 0], ids[:, -1]]), minlength=len(count))
    for a, b, n in k.shared_sides(ids):
        around[a] += n
        around[b] += n
    group = groups_of(ids, subject) if subject is not None else {}
    out = []
    for r in sorted(classes):
        wide, high, thick = int(high_x[r] - low_x[r] + 1), int(high_y[r] - low_y[r] + 1), float(2 * deepest[r] * scale)
        out.append({
            "region_id": r, "palette_index": int(classes[r]), "pixel_count": int(count[r]), "pixel_percent": 100.0 * count[r] / ids.size, "area_mm2": float(count[r] * scale**2), "min_x": int(low_x[r]), "min_y": int(low_y[r]), "max_x": int(high_x[r]), "max_y": int(high_y[r]),
            "width": wide, "height": high, "centroid_x": float(cx[r]), "centroid_y": float(cy[r]), "max_thickness_mm": thick, "aspect_ratio": max(wide, high) / min(wide, high), "compactness": float(4 * math.pi * count[r] / max(1, around[r]) ** 2),
            "is_below_area_threshold": bool(count[r] < least_pixels), "is_thin": thick < config.thin_width_mm, "is_subject": bool(group.get(r, 0)),
        })
    return out


def edge_rows(ids: np.ndarray, classes: dict[int, int], colours: np.ndarray) -> list[dict]:
    """Neighbouring regions with their palette entries and the colour difference."""
    return [{"region_a": a, "region_b": b, "boundary_pixels": n, "palette_a": int(classes[a]), "palette_b": int(classes[b]), "delta_e76": float(np.linalg.norm(colours[classes[a]] - colours[classes[b]]))} for a, b, n in k.shared_sides(ids)]


def smoothed(line: list[k.Point], profile: dict) -> list[k.Point]:
    """A traced line without steps: corners cut where it is long or large enough; ends stay, as other lines meet there."""
    closed = line[0] == line[-1]
    if closed:
        x, y = np.array(line, float).T
        if len(line) < 7 or abs(float(x[:-1] @ y[1:] - x[1:] @ y[:-1])) / 2 < profile["min_smooth_area_px"]:
            return line
    elif len(line) < 3:
        return line
    return k.cut_corners(line, profile["smoothing_iterations"], closed)


def make_sheet(rgb: np.ndarray, config: Config, subject: np.ndarray | None = None, detail: np.ndarray | None = None) -> dict:
    """One image's sheet: palette, tables of regions, edges, labels and merges, and the drawings."""
    height, width = rgb.shape[:2]
    config = tuned(config, width, height)
    if config.subject_mode == "none":
        subject = None
    made = segment(rgb, config, subject, detail)
    page_w, page_h, scale, left, top = made.page
    ids, classes, log = merge(made, config, config.merge_strategy, subject)
    least = max(1, math.ceil(config.min_region_area_mm2 / scale**2))
    profile = rendering(config, scale)
    far = k.distance_to_outside(ids)
    labels = place_labels(ids, classes, config, scale, far)
    lines = [(k.simplify(smoothed(line, profile), profile["simplify_tolerance_px"]), "#222", profile["line_width_mm"]) for line in k.trace(k.boundary_edges(ids))]
    strokes = np.zeros(ids.shape, bool)
    if config.line_art_enabled:
        strokes = k.line_art(made.unit @ np.array([0.2125, 0.7154, 0.0721]), subject, detail, ids, config.line_art_detail)
        lines += [(k.simplify(line, max(0.25, 0.55 * profile["simplify_tolerance_px"])), "#666", profile["line_width_mm"] * 0.7) for line in k.skeleton_paths(strokes)]
    if subject is not None:
        outlines = [k.simplify(smoothed(ring, profile), profile["simplify_tolerance_px"]) for ring in k.mask_contours(subject)]
        lines += [(ring, "black", profile["line_width_mm"] * 1.55) for ring in outlines if len(ring) >= 4]
    path = lambda line: "M " + " L ".join(f"{left + x * scale:.3f} {top + y * scale:.3f}" for x, y in line)
    svg = sinks.svg_sheet(page_w, page_h, config.title, [(path(p), c, w) for p, c, w in lines], [(left + r["x_px"] * scale, top + r["y_px"] * scale, r["font_size_mm"], str(r["number"])) for r in labels if r["status"] == "placed"])
    after = np.array([0, *(classes[i] for i in range(1, len(classes) + 1))])[ids]
    before_counts, counts = (np.bincount(a.ravel(), minlength=len(made.colours)) for a in (made.labels, after))
    palette = [{"palette_index": i, "hex": lab_hex(c), "l": float(c[0]), "a": float(c[1]), "b": float(c[2]), "pixels_before": int(m), "pixels_after": int(n)} for i, (c, m, n) in enumerate(zip(made.colours, before_counts, counts))]
    shown = np.array([[int(c["hex"][i : i + 2], 16) for i in (1, 3, 5)] for c in palette])
    line = k.boundary(ids)[..., None]
    blank = np.where(line, 40, np.where(strokes[..., None], 102, 255)) * np.ones(3, int)
    placed = [r for r in labels if r["status"] == "placed"]
    numbered = sinks.draw_numbers(blank, [(r["x_px"], r["y_px"], r["font_size_mm"] / scale, str(r["number"])) for r in placed])
    on_sheet = sinks.Page(blank, (left, top, width * scale, height * scale), tuple((left + r["x_px"] * scale, top + r["y_px"] * scale, r["font_size_mm"], str(r["number"])) for r in placed))
    drawn = {
        "normalised": np.rint(rgb), "quantised": shown[made.quantised], "segmented": shown[made.labels], "merged": shown[after], "model": np.where(line, 40, shown[after]), "coloring": numbered, "contours": np.where(line, 0, 255) * np.ones(3, int),
        "regions_before": preview(made.ids), "regions_after": preview(ids), "line_art": np.where(strokes[..., None], 0, 255) * np.ones(3, int), "palette_page": palette_page(shown, page_w / page_h),
    }
    if subject is not None:
        drawn |= {"subject_mask": subject * 255, "subject_overlay": k.mask_overlay(rgb, subject)}
    if detail is not None:
        drawn |= {"detail_mask": detail * 255}
    return {
        "width": width, "height": height, "mm_per_pixel": scale, "recolored_pixels": int((made.labels != after).sum()), "line_art_pixels": int(strokes.sum()), "palette": palette,
        "regions_before": region_rows(made.ids, made.classes, least, config, scale, subject), "regions": region_rows(ids, classes, least, config, scale, subject, far), "adjacency_before": edge_rows(made.ids, made.classes, made.colours), "adjacency": edge_rows(ids, classes, made.colours),
        "labels": labels, "merges": [m._asdict() for m in log], "rendering": profile, "region_before": made.ids.ravel().astype(np.int32), "region_after": ids.ravel().astype(np.int32), "svg": svg, "palette_svg": palette_sheet(palette, config, page_w, page_h),
        "images": {name: sinks.png(image) for name, image in drawn.items()}, "pdf": sinks.pdf([on_sheet, drawn["palette_page"]], page_w, page_h),
    }


def preview(ids: np.ndarray) -> np.ndarray:
    """A colour for every region."""
    return np.stack([(ids * a + b) % 223 + 24 for a, b in ((67, 29), (131, 47), (197, 71))], -1)


def on_page(image: np.ndarray, shape: float) -> np.ndarray:
    """The image in the middle of a white page with the given ratio of width to height."""
    height, width = image.shape[:2]
    page_h = max(math.ceil(height * 1.1), math.ceil(width * 1.1 / shape))
    page_w = math.ceil(page_h * shape)
    out = np.full((page_h, page_w, 3), 255)
    y, x = (page_h - height) // 2, (page_w - width) // 2
    out[y : y + height, x : x + width] = image
    return out


def palette_page(colours: np.ndarray, shape: float, cell: int = 40, columns: int = 4) -> np.ndarray:
    """Colour fields in reading order on a page."""
    rows = -(-len(colours) // columns)
    grid = np.full((rows * columns, 3), 255)
    grid[: len(colours)] = colours
    fields = np.kron(grid.reshape(rows, columns, 3), np.ones((cell, cell, 1), int))
    fields[::cell] = fields[:, ::cell] = 255
    return on_page(fields, shape)


def palette_sheet(palette: list[dict], config: Config, page_w: float, page_h: float) -> str:
    """The palette's colour fields with their numbers as a vector sheet."""
    columns = max(1, int((page_w - 2 * config.margin_mm) // 30))
    place = lambda i: (config.margin_mm + i % columns * 30, config.margin_mm + 9 + i // columns * 7)
    fields = [(f"M {x:g} {y:g} L {x + 8:g} {y:g}", c["hex"], 5.0) for c in palette for x, y in [place(c["palette_index"])]]
    numbers = [(x + 14, y, 3.2, str(c["palette_index"] + 1)) for c in palette for x, y in [place(c["palette_index"])]]
    return sinks.svg_sheet(page_w, page_h, config.title, fields, numbers)


def place_labels(ids: np.ndarray, classes: dict[int, int], config: Config, scale: float, far: np.ndarray) -> list[dict]:
    """Every region's label at its innermost pixel nearest to the centroid, with a font that fits."""
    count = np.bincount(ids.ravel())
    deepest = np.zeros(len(count))
    np.maximum.at(deepest, ids.ravel(), far.ravel())
    yy, xx = np.mgrid[: ids.shape[0], : ids.shape[1]]
    cy, cx = (np.bincount(ids.ravel(), a.ravel()) / np.maximum(1, count) for a in (yy, xx))
    inner = np.flatnonzero(np.isclose(far.ravel(), deepest[ids.ravel()]))
    of = ids.ravel()[inner]
    off = (yy.ravel()[inner] - cy[of]) ** 2 + (xx.ravel()[inner] - cx[of]) ** 2
    order = np.lexsort((inner, off, of))
    first = order[np.unique(of[order], return_index=True)[1]]
    out = []
    for at, r in zip(inner[first].tolist(), of[first].tolist()):
        area, clearance = count[r] * scale**2, max(0.5 * scale, (deepest[r] - 0.5) * scale)
        ratio = area / max(config.min_region_area_mm2, scale**2, 1e-9)
        grown = min(1.0, max(0.0, (math.sqrt(ratio) - 1) / (math.sqrt(12) - 1))) if ratio > 1 else 0.0
        target = config.min_number_font_mm + (config.number_font_mm - config.min_number_font_mm) * grown
        room = max(0.15 * scale, 2 * clearance - 2 * min(config.number_padding_mm, 0.24 * clearance))
        font = min(target, room / max(1.0, 0.62 * len(str(classes[r] + 1))))
        out.append({
            "region_id": r, "palette_index": int(classes[r]), "number": int(classes[r]) + 1, "status": "placed", "reason": "police_reduite_sous_seuil" if font + 1e-9 < config.min_number_font_mm else "",
            "x_px": at % ids.shape[1] + 0.5, "y_px": at // ids.shape[1] + 0.5, "clearance_mm": float(clearance), "font_size_mm": float(font),
        })
    return out


def _arrays(group: pd.DataFrame, masks: list[str]) -> tuple[np.ndarray, dict]:
    """A pixel group's colours as an image, and its masks; masks without a set pixel are none."""
    shape = (int(group["y"].max()) + 1, int(group["x"].max()) + 1)
    rgb = np.full((*shape, 3), 255.0)
    rgb[group["y"], group["x"]] = group[["r", "g", "b"]]
    held = {}
    for name in masks:
        mask = np.zeros(shape, bool)
        mask[group["y"], group["x"]] = group[name].astype(bool)
        held[name] = mask if mask.any() else None
    return rgb, held


def _grouped(pixels: DataFrame):
    masks = [c for c in ("subject", "detail") if c in pixels.columns]
    return masks, pixels.select("image_id", "x", "y", "r", "g", "b", *masks).groupBy("image_id")


def sheets(pixels: DataFrame, config: Config) -> DataFrame:
    """Sheets of all images of a pixel table (r, g, b and, where there are any, boolean columns subject and detail)."""
    config.checked()
    masks, grouped = _grouped(pixels)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rgb, held = _arrays(group, masks)
        return pd.DataFrame([{"image_id": str(group["image_id"].iloc[0])} | make_sheet(rgb, config, **held)])

    return grouped.applyInPandas(run, SHEET)


def _summary(regions: str) -> Column:
    """Counts, sizes with exact median and shares of an array of regions."""
    sizes, n = F.array_sort(F.transform(regions, lambda r: r["pixel_count"])), F.size(regions)
    half = F.floor(n / 2).cast("int")
    count = lambda flag: F.size(F.filter(regions, lambda r: r[flag]))
    median = F.when(n % 2 == 1, F.get(sizes, half)).otherwise((F.get(sizes, half - 1) + F.get(sizes, half)) / 2).cast("double")
    return F.struct(
        n.alias("count"), F.array_min(sizes).alias("min_pixels"), F.array_max(sizes).alias("max_pixels"), median.alias("median_pixels"), F.array_min(F.transform(regions, lambda r: r["area_mm2"])).alias("min_area_mm2"),
        count("is_below_area_threshold").alias("below_area_threshold_count"), (100.0 * count("is_below_area_threshold") / n).alias("below_area_threshold_percent"), count("is_thin").alias("thin_region_count"), (100.0 * count("is_thin") / n).alias("thin_region_percent"),
    )


def _graph(regions: str, edges: str) -> Column:
    total = F.aggregate(F.transform(edges, lambda e: e["boundary_pixels"]), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.struct(F.size(regions).alias("nodes"), F.size(edges).alias("edges"), (2.0 * F.size(edges) / F.size(regions)).alias("mean_degree"), total.alias("total_shared_boundary_pixels"))


def stats(made: DataFrame, config: Config | None = None) -> DataFrame:
    """One report row per sheet."""
    placed = F.filter("labels", lambda r: r["status"] == "placed")
    fonts = F.transform(placed, lambda r: r["font_size_mm"])
    skipped = F.transform(F.filter("labels", lambda r: r["status"] != "placed"), lambda r: r["region_id"])
    labelling = F.struct(
        F.size("labels").alias("region_count"), F.size(placed).alias("placed_count"), F.size(skipped).alias("skipped_count"), F.when(F.size("labels") > 0, 100.0 * F.size(placed) / F.size("labels")).otherwise(0.0).alias("coverage_percent"), skipped.alias("skipped_region_ids"),
        F.size(F.filter(placed, lambda r: r["reason"] != "")).alias("reduced_font_count"), F.coalesce(F.array_min(fonts), F.lit(0.0)).alias("smallest_font_mm"),
    )
    pixels = F.col("width").cast("long") * F.col("height")
    parameters = [F.lit(json.dumps(asdict(config), sort_keys=True)).alias("parameters")] if config else []
    return made.select(
        "image_id", F.lit("3.4").alias("schema_version"), "width", "height", "mm_per_pixel", *parameters, F.size("palette").alias("actual_colors"), pixels.alias("pixel_count"), _summary("regions_before").alias("regions_before"), _summary("regions").alias("regions_after"),
        _graph("regions_before", "adjacency_before").alias("graph_before"), _graph("regions", "adjacency").alias("graph_after"), F.size("merges").alias("merge_count"), F.size(F.filter("merges", lambda m: m["forced_by_tolerance"])).alias("forced_merges"),
        "recolored_pixels", (100.0 * F.col("recolored_pixels") / pixels).alias("recolored_pixel_percent"), labelling.alias("labeling"), "rendering", "line_art_pixels", F.size(F.filter("regions", lambda r: r["is_subject"])).alias("subject_regions_after"),
    )


COMPARED = "image_id string, strategy string, regions_before long, regions_after long, merges long, forced_merges long, below_threshold_after long, thin_regions_after long, recolored_pixel_percent double, duration_ms double"


#: Largest width of a panel and height of the strip above it, in pixels.
PANEL_WIDTH, STRIP_HEIGHT = 420, 64


def strategy_plate(panels: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Images of one size side by side, made smaller by nearest pixels, each below its number of regions."""
    height, width = panels[0][0].shape[:2]
    wide = min(PANEL_WIDTH, width)
    high = max(1, round(height * wide / width))
    rows, columns = (np.minimum((2 * np.arange(n) + 1) * m // (2 * n), m - 1) for n, m in ((high, height), (wide, width)))
    out = np.full((STRIP_HEIGHT + high, wide * len(panels), 3), 255)
    for i, (image, _) in enumerate(panels):
        out[STRIP_HEIGHT:, i * wide : (i + 1) * wide] = image[rows][:, columns]
    return sinks.draw_numbers(out, [((i + 0.5) * wide, STRIP_HEIGHT / 2, 24.0, str(n)) for i, (_, n) in enumerate(panels)])


def compare_strategies(pixels: DataFrame, config: Config, drawn: bool = False) -> DataFrame:
    """One row per image and merge strategy; each image is segmented once, only the merge is run for every strategy.

    ``drawn`` adds ``plate`` to an image's first row (null in its others): a PNG of all strategies' coloured regions with their borders, in the order of the rows.
    """
    config.checked()
    masks, grouped = _grouped(pixels)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rgb, held = _arrays(group, masks)
        own = tuned(config, rgb.shape[1], rgb.shape[0])
        subject = held.get("subject") if own.subject_mode != "none" else None
        made, rows, panels = segment(rgb, own, subject, held.get("detail")), [], []
        scale, colours = made.page[2], np.array([[int(lab_hex(c)[i : i + 2], 16) for i in (1, 3, 5)] for c in made.colours])
        for strategy in k.STRATEGIES:
            began = time.perf_counter()
            ids, classes, log = merge(made, own, strategy, subject)
            spent = 1000 * (time.perf_counter() - began)
            after = region_rows(ids, classes, max(1, math.ceil(own.min_region_area_mm2 / scale**2)), own, scale)
            merged = np.array([0, *(classes[i] for i in range(1, len(classes) + 1))])[ids]
            changed = (made.labels != merged).mean()
            if drawn:
                panels.append((np.where(k.boundary(ids)[..., None], 40, colours[merged]), len(classes)))
            rows.append((str(group["image_id"].iloc[0]), strategy, len(made.classes), len(classes), len(log), sum(m.forced_by_tolerance for m in log), sum(r["is_below_area_threshold"] for r in after), sum(r["is_thin"] for r in after), round(100.0 * float(changed), 6), spent))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in COMPARED.split(", ")])
        return out.assign(plate=[sinks.png(strategy_plate(panels)), *[None] * (len(rows) - 1)]) if drawn else out

    return grouped.applyInPandas(run, COMPARED + ", plate binary" if drawn else COMPARED)


def export_comparison(pixels: DataFrame, path: str, config: Config, overwrite: bool = False) -> DataFrame:
    """Write every image's strategies below ``path`` as a CSV table, JSON lines and plates (Parquet, one PNG an image); gives back the rows."""
    from rasterloom.session import materialize

    compared = materialize(compare_strategies(pixels, config, drawn=True), "strategies")
    rows = compared.drop("plate")
    sinks.write_table(rows, f"{path}/strategies-comparison", "strategies", overwrite)
    sinks.write_report(rows.withColumns({"recolored_pixel_percent": F.round("recolored_pixel_percent", 6), "duration_ms": F.round("duration_ms", 3)}), f"{path}/strategies-comparison-json", overwrite)
    compared.where("plate is not null").select("image_id", "plate").write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/strategies-comparison-plates")
    return rows


#: The two profiles of the quality gate.
PROFILES = {
    "legacy": {"segmentation": "slic_legacy", "palette_merge_delta_e": 0.0, "thin_merge_passes": 0, "line_art_enabled": False},
    "v1": {"segmentation": "slic"},
}


def quality_metrics(pixels: DataFrame, config: Config) -> DataFrame:
    """The gate's metrics of every image under every profile."""
    rows = None
    for name, own in PROFILES.items():
        s = stats(sheets(pixels, replace(config, **own)))
        one = s.select(
            "image_id", F.lit(name).alias("profile"), "actual_colors", F.col("regions_after.count").alias("regions_after"), F.col("regions_after.thin_region_count").alias("thin_regions"), F.col("labeling.skipped_count").alias("skipped_count"), F.col("labeling.coverage_percent").alias("coverage_percent"),
            F.col("labeling.reduced_font_count").alias("reduced_font_count"), F.col("labeling.smallest_font_mm").alias("smallest_font_mm"), "forced_merges", "recolored_pixels", "line_art_pixels",
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def export(made: DataFrame, path: str, overwrite: bool = False, config: Config | None = None) -> None:
    """Tables, region ids of every pixel, report and drawings of all sheets below ``path``."""
    rows = lambda column: made.select("image_id", F.explode(column).alias("r")).select("image_id", "r.*")
    channel = lambda i: F.conv(F.substring("hex", i, 2), 16, 10).cast("int")
    palette = rows("palette").withColumns({"number": F.col("palette_index") + 1, "red": channel(2), "green": channel(4), "blue": channel(6), "lab_l": F.col("l"), "lab_a": F.col("a"), "lab_b": F.col("b")})
    sinks.write_table(palette, f"{path}/palette", "palette", overwrite)
    for name, kind, column in (("regions-before", "regions", "regions_before"), ("regions", "regions", "regions"), ("adjacency-before", "adjacency", "adjacency_before"), ("adjacency", "adjacency", "adjacency"), ("merges", "merges", "merges"), ("labels", "labels", "labels")):
        sinks.write_table(rows(column), f"{path}/{name}", kind, overwrite)
    mode = "overwrite" if overwrite else "errorifexists"
    ids = made.select("image_id", "width", F.posexplode(F.arrays_zip("region_before", "region_after")).alias("at", "r"))
    ids.select("image_id", (F.col("at") % F.col("width")).alias("x"), F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), "r.region_before", "r.region_after").write.mode(mode).parquet(f"{path}/region-ids")
    sinks.write_report(stats(made, config), f"{path}/stats", overwrite)
    made.select("image_id", "svg", "palette_svg", "images", "pdf").write.mode(mode).parquet(f"{path}/drawings")


def run_images(spark: SparkSession, source: str, target: str, config: Config, overwrite: bool = False) -> None:
    """Sheets of all images below ``source``."""
    from rasterloom.session import materialize
    from rasterloom.sources.images import read_pixels

    export(materialize(sheets(read_pixels(spark, source, config.max_side), config), "sheets"), target, overwrite, config)


