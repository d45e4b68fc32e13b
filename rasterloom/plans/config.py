"""Parameters of the colouring pipeline, their ranges, and the check of both for one set or a table of them."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the numbers, allowed names, and numbers that must be above zero.
RANGES = {
    "colors": (2, 40), "max_side": (64, 8000), "superpixels": (10, 20000), "smoothing_radius": (0, 8), "margin_mm": (0, math.inf), "legend_height_mm": (0, math.inf),
    "number_padding_mm": (0, math.inf), "contour_smoothing_iterations": (0, 4), "min_contour_smooth_area_px": (0, math.inf), "contour_simplify_mm": (0, 1), "preprocess_sigma_color": (0.001, 0.25),
    "preprocess_sigma_spatial": (0.25, 12), "palette_merge_delta_e": (0, 20), "thin_merge_passes": (0, 5), "line_art_detail": (0, 1), "mask_threshold": (1, 254), "subject_color_ratio": (0.5, 0.85),
    "background_superpixel_ratio": (0.1, 1), "background_smoothing_radius": (0, 8),
}
CHOICES = {
    "connectivity": (4, 8), "segmentation": ("components", "slic", "slic_legacy"), "merge_strategy": ("color", "boundary", "balanced"), "page_format": ("a4", "a3"),
    "orientation": ("portrait", "landscape"), "palette_layout": ("inline", "separate"), "subject_mode": ("none", "ai", "manual"),
}
POSITIVE = ("compactness", "color_tolerance", "min_region_area_mm2", "thin_width_mm", "number_font_mm", "min_number_font_mm", "line_width_mm", "subject_min_region_area_mm2", "background_min_region_area_mm2", "detail_min_region_area_mm2")
#: Fewest colours where subject and background have their own.
SPLIT_COLORS = 4


@dataclass(frozen=True)
class Config:
    """Grouped by the step that reads them; the defaults are fixed values."""

    # image and palette
    max_side: int = 1200
    auto_tune: bool = False
    preprocess_sigma_color: float = 0.055
    preprocess_sigma_spatial: float = 3.0
    colors: int = 12
    sample_pixels: int = 100_000
    seed: int = 42
    palette_merge_delta_e: float = 4.0
    # regions
    segmentation: str = "slic"
    superpixels: int = 900
    compactness: float = 10.0
    smoothing_radius: int = 1
    connectivity: int = 8
    # subject and details
    subject_mode: str = "none"
    mask_threshold: int = 128
    subject_color_ratio: float = 0.68
    background_superpixel_ratio: float = 0.45
    background_smoothing_radius: int = 3
    subject_min_region_area_mm2: float = 6.0
    background_min_region_area_mm2: float = 28.0
    detail_min_region_area_mm2: float = 4.0
    # merging
    min_region_area_mm2: float = 9.0
    thin_width_mm: float = 1.5
    thin_merge_passes: int = 2
    merge_strategy: str = "balanced"
    color_tolerance: float = 35.0
    # page and numbers
    title: str = "Colour by number"
    page_format: str = "a4"
    orientation: str = "portrait"
    margin_mm: float = 12.0
    palette_layout: str = "inline"
    legend_height_mm: float = 0.0
    number_font_mm: float = 3.2
    min_number_font_mm: float = 1.8
    number_padding_mm: float = 0.45
    # lines
    line_width_mm: float = 0.25
    contour_smoothing_iterations: int = 1
    min_contour_smooth_area_px: float = 18.0
    contour_simplify_mm: float = 0.10
    line_art_enabled: bool = True
    line_art_detail: float = 0.65

    def problems(self) -> list[str]:
        """Names of the parameters that are out of range or do not go together, each once."""
        return [name for name, broken in rules(lambda name: getattr(self, name), lambda value, allowed: value in allowed) if broken]

    def checked(self) -> Config:
        if problems := list(dict.fromkeys(self.problems())):
            raise ValueError(f"out of range: {', '.join(problems)}")
        return self

    @classmethod
    def from_mapping(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def split_colors(self) -> tuple[int, int]:
        """Colours of subject and background; ties round to even."""
        subject = max(2, round(self.colors * self.subject_color_ratio))
        background = max(2, self.colors - subject)
        return self.colors - background if subject + background > self.colors else subject, background


def rules(value, among):
    """Every rule as (name, whether it is broken); ``value`` gives a parameter's value or column, ``among`` tests a value against names."""
    for name, (low, high) in RANGES.items():
        yield name, (value(name) < low) | (value(name) > high)
    for name, allowed in CHOICES.items():
        yield name, among(value(name), allowed) == False  # noqa: E712
    for name in POSITIVE:
        yield name, value(name) <= 0
    yield "min_number_font_mm", value("min_number_font_mm") > value("number_font_mm")
    yield "sample_pixels", value("sample_pixels") < value("colors")
    yield "colors", (value("subject_mode") != "none") & (value("colors") < SPLIT_COLORS)


def violations(given: dict[str, Column]) -> Column:
    """The sorted names of broken rules of every row; parameters that are not given have their defaults."""
    defaults = Config()
    value = lambda name: given[name] if name in given else F.lit(getattr(defaults, name))
    broken = [F.when(rule, F.lit(name)) for name, rule in rules(value, lambda column, allowed: column.isin(*allowed))]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*broken))))
