"""Physical sheet geometry, adaptive parameters and label sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.color import clamp

#: Page sizes in millimetres.
PAGES_MM = {"a4": (210.0, 297.0), "a3": (297.0, 420.0)}
#: Presets by complexity.
PRESET_FIELDS = ("superpixels", "min_region_area_mm2", "subject_min_region_area_mm2", "background_min_region_area_mm2", "background_superpixel_ratio", "background_smoothing_radius", "detail_min_region_area_mm2", "contour_smoothing_iterations")
PRESETS = {
    "simple": (620, 14.0, 8.0, 36.0, 0.35, 4, 3.5, 2),
    "default": (900, 9.0, 6.0, 28.0, 0.45, 3, 3.0, 1),
    "detaille": (1350, 6.0, 4.0, 20.0, 0.55, 2, 2.0, 1),
}
#: Scales by size class (superpixels, region, subject, background and detail area).
SCALES = {"large": (1.22, 0.90, 0.90, 0.95, 0.75), "small": (0.72, 1.35, 1.15, 1.20, 1.0), "medium": (1.0, 1.0, 1.0, 1.0, 1.0)}
#: Least smoothing, background smoothing, contour iterations and smoothed area by size class.
LEAST = {"large": (1, 2, 1, 18.0), "small": (2, 4, 2, 24.0), "medium": (1, 0, 1, 0.0)}
FULL_SIZE_RATIO = 12.0


def pick(key: Column, values: dict[str, float]) -> Column:
    """A literal lookup; keys that are not listed give null."""
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def page_size(page_format: Column, orientation: Column) -> tuple[Column, Column]:
    short, long = (pick(page_format, {k: v[i] for k, v in PAGES_MM.items()}) for i in (0, 1))
    return F.when(orientation == "landscape", long).otherwise(short), F.when(orientation == "landscape", short).otherwise(long)


def print_geometry(width: Column, height: Column, page_format: Column, orientation: Column, margin: Column, min_area: Column, reserved: Column) -> dict[str, Column]:
    page_w, page_h = page_size(page_format, orientation)
    room_w, room_h = page_w - 2.0 * margin, page_h - 2.0 * margin
    box_h = room_h - reserved
    scale = F.least(room_w / width, box_h / height)
    return {
        "page_width_mm": page_w, "page_height_mm": page_h, "printable_width_mm": room_w, "printable_height_mm": room_h,
        "image_width_mm": width * scale, "image_height_mm": height * scale,
        "image_origin_x_mm": margin + (room_w - width * scale) / 2.0, "image_origin_y_mm": margin + (box_h - height * scale) / 2.0,
        "legend_origin_y_mm": margin + box_h, "mm_per_pixel": scale, "pixel_area_mm2": scale * scale,
        "min_region_pixels": F.greatest(F.lit(1), F.ceil(min_area / (scale * scale)).cast("int")),
    }


def legend_height(page_format: Column, orientation: Column, margin: Column, colors: Column) -> Column:
    page_w, _ = page_size(page_format, orientation)
    columns = F.greatest(F.lit(1), F.floor((page_w - 2.0 * margin) / 30.0).cast("int"))
    return F.when(colors <= 0, 0.0).otherwise(9.0 + 7.0 * F.ceil(colors / columns))


def size_class(width: Column, height: Column) -> Column:
    long, pixels = F.greatest(width, height), width * height
    return F.when((long >= 1400) | (pixels >= 1_400_000), "large").when((long <= 900) | (pixels <= 600_000), "small").otherwise("medium")


def auto_tune(kind: Column, superpixels: Column, area: Column, subject: Column, background: Column, detail: Column, smoothing: Column) -> dict[str, Column]:
    scale = [pick(kind, {k: v[i] for k, v in SCALES.items()}) for i in range(5)]
    return {
        "tuned_superpixels": clamp(F.rint(superpixels * scale[0]), 10.0, 20000.0).cast("int"),
        "tuned_area_mm2": clamp(area * scale[1], 1.0, 80.0), "tuned_subject_mm2": clamp(subject * scale[2], 1.0, 80.0),
        "tuned_background_mm2": clamp(background * scale[3], 1.0, 120.0), "tuned_detail_mm2": clamp(detail * scale[4], 0.75, 40.0),
        "tuned_smoothing": F.greatest(smoothing, pick(kind, {k: v[0] for k, v in LEAST.items()})).cast("int"),
    }


def auto_max_side(long_side: Column, default: int = 1200, maximum: int = 2400) -> Column:
    target = F.when(long_side <= 900, min(default, 900)).when(long_side >= 2400, max(default, 1600)).otherwise(default)
    return clamp(target, 256, maximum).cast("int")


def scaled_font(area: Column, min_area: Column, pixel_area: Column, preferred: Column, least: Column) -> Column:
    """Font size that grows with the root of a region's area up to the preferred one."""
    ratio = F.greatest(F.lit(0.0), area) / F.greatest(min_area, pixel_area, F.lit(1e-9))
    progress = F.when(ratio > 1.0, (F.sqrt(ratio) - 1.0) / (FULL_SIZE_RATIO**0.5 - 1.0)).otherwise(0.0)
    return least + (preferred - least) * clamp(progress, 0.0, 1.0)


def fitted_font(number: Column, distance: Column, scale: Column, target: Column, padding: Column, least: Column) -> dict[str, Column]:
    """Clearance, font size and note of a label at a place ``distance`` pixels from the region's edge."""
    clearance = F.greatest(0.5 * scale, (distance - 0.5) * scale)
    digits = F.greatest(F.lit(1.0), 0.62 * F.length(number.cast("string")))
    usable = F.greatest(scale * 0.15, 2.0 * clearance - 2.0 * F.least(padding, 0.12 * 2.0 * clearance))
    font = F.least(target, usable / digits)
    return {"clearance_mm": clearance, "font_size_mm": font, "reason": F.when(font + 1e-9 < least, "police_reduite_sous_seuil").otherwise("")}


def render_profile(page_format: Column, scale: Column, line_width: Column, smoothing: Column, min_area: Column, min_smooth: Column, simplify: Column) -> dict[str, Column]:
    page_scale = F.when(page_format == "a3", 1.12).otherwise(1.0)
    boost = clamp((scale - 0.16) * 0.45, 0.0, 0.06)
    coarse = clamp(smoothing + 1, 2, 3)
    return {
        "line_width_mm": clamp(line_width * page_scale + boost, 0.18, 0.42),
        "smoothing_iterations": F.when(scale >= 0.22, coarse).otherwise(F.greatest(F.lit(1), smoothing)).cast("int"),
        "min_smooth_area_px": F.greatest(min_smooth, clamp(min_area * 0.4, 2.5, 8.0) / F.greatest(scale * scale, F.lit(1e-9))),
        "simplify_tolerance_px": simplify / F.greatest(scale, F.lit(1e-9)),
    }


def palette_cell(index: Column, columns: int, left: float, top: float, cell_w: float, cell_h: float) -> tuple[Column, Column]:
    return F.lit(left) + (index % columns) * cell_w, F.lit(top) + F.floor(index / columns) * cell_h


def clamp_or(value: Column, low: float, high: float, default: float, kind: str = "double") -> Column:
    """Text as a number within limits, or the default where it is none."""
    return F.coalesce(clamp(value.try_cast(kind), F.lit(low).cast(kind), F.lit(high).cast(kind)), F.lit(default).cast(kind))


def bool_or(value: Column, default: bool = True) -> Column:
    return F.when(value.isNull(), F.lit(default)).otherwise(~F.lower(F.trim(value)).isin("0", "false", "non", "off"))


def page_format_of(value: Column) -> Column:
    return F.when(F.lower(value) == "a3", "a3").otherwise("a4")


def orientation_of(value: Column) -> Column:
    return F.when(F.lower(value).isin("paysage", "landscape"), "landscape").otherwise("portrait")


def palette_layout_of(value: Column) -> Column:
    return F.when(F.lower(value) == "inline", "inline").otherwise("separate")


def preset(value: Column) -> dict[str, Column]:
    key = F.when(value.isin("simple", "detaille"), value).otherwise("default")
    return {name: pick(key, {k: float(v[i]) for k, v in PRESETS.items()}) for i, name in enumerate(PRESET_FIELDS)}
