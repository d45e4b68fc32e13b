"""Region merging as grouped maps over images, and one-round forms in DataFrame operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import grid
from rasterloom.operators.kernels import STRATEGIES, distance_to_outside, improve_labels, merge_image
from rasterloom.operators.regions import to_dense

EVENT_FIELDS = "step int, source_region long, target_region long, source_palette_index int, target_palette_index int, source_pixels long, shared_boundary_pixels long, delta_e76 double, forced_by_tolerance boolean"


def _image_merge(group: pd.DataFrame, colours: np.ndarray, least: int, strategy: str, tolerance: float):
    labels, _ = to_dense(group, "region_id")
    classes = group.groupby("region_id")["p"].first().to_dict()
    return labels, merge_image(labels, classes, dict.fromkeys(classes, least), colours, strategy, tolerance)


def merge_small_regions(pixels: DataFrame, colours: np.ndarray, least: int, strategy: str = "balanced", tolerance: float = 35.0) -> DataFrame:
    """Pixels with ``merged_region`` and ``merged_p`` after all regions below ``least`` pixels are merged."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        _, (labels, classes, _) = _image_merge(group, colours, least, strategy, tolerance)
        merged = labels[group["y"], group["x"]]
        return group[["image_id", "x", "y", "p", "region_id"]].assign(merged_region=merged, merged_p=pd.Series(merged, group.index).map(classes))

    return pixels.select("image_id", "x", "y", "p", "region_id").groupBy("image_id").applyInPandas(run, "image_id int, x int, y int, p int, region_id long, merged_region long, merged_p int")


def merge_log(pixels: DataFrame, colours: np.ndarray, least: int, strategy: str = "balanced", tolerance: float = 35.0) -> DataFrame:
    """The merges of every image in order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        _, (_, _, log) = _image_merge(group, colours, least, strategy, tolerance)
        return pd.DataFrame(log, columns=[f.split()[0] for f in EVENT_FIELDS.split(", ")]).assign(image_id=group["image_id"].iloc[0])

    return pixels.groupBy("image_id").applyInPandas(run, f"{EVENT_FIELDS}, image_id int")


def labelability(pixels: DataFrame, colours: np.ndarray, scale: float, least_pixels: int, least_area: float, least_font: float = 1.8, padding: float = 0.45, strategy: str = "balanced", tolerance: float = 35.0, passes: int = 2) -> DataFrame:
    """Pixels with ``merged_region`` and ``merged_p`` after regions too narrow for their number are merged."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        labels, _ = to_dense(group, "region_id")
        classes = group.groupby("region_id")["p"].first().to_dict()
        labels, classes, _ = improve_labels(labels, classes, colours, scale, least_pixels, least_area, least_font, padding, strategy, tolerance, None, passes)
        merged = labels[group["y"], group["x"]]
        return group[["image_id", "x", "y"]].assign(merged_region=merged, merged_p=pd.Series(merged, group.index).map(classes))

    return pixels.select("image_id", "x", "y", "p", "region_id").groupBy("image_id").applyInPandas(run, "image_id int, x int, y int, merged_region long, merged_p int")


COMPARED = "image_id int, strategy string, regions_before long, regions_after long, merges long, forced_merges long, below_threshold_after long, thin_regions_after long, recolored_pixel_percent double"


def compare(pixels: DataFrame, colours: np.ndarray, least: int, scale: float, thin_mm: float, tolerance: float = 35.0) -> DataFrame:
    """What every strategy makes of the same regions: one row per image and strategy."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        before, _ = to_dense(group, "p")
        rows = []
        for strategy in STRATEGIES:
            _, (labels, classes, log) = _image_merge(group, colours, least, strategy, tolerance)
            count, far = np.bincount(labels.ravel()), np.zeros(len(classes) + 1)
            np.maximum.at(far, labels.ravel(), distance_to_outside(labels).ravel())
            after = np.array([-1, *(classes[i] for i in range(1, len(classes) + 1))])[labels]
            present = labels > 0
            changed = 100.0 * float((after[present] != before[present]).mean())
            rows.append((group["image_id"].iloc[0], strategy, group["region_id"].nunique(), len(classes), len(log), sum(m.forced_by_tolerance for m in log), int((count[1:] < least).sum()), int((2 * far[1:] * scale < thin_mm).sum()), round(changed, 6)))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in COMPARED.split(", ")])

    return pixels.select("image_id", "x", "y", "p", "region_id").groupBy("image_id").applyInPandas(run, COMPARED)


def strategy_key(strategy: str, difference: Column, shared: Column, source: Column, target: Column, region: Column) -> Column:
    """A candidate's sort key; the smallest is chosen, the smaller region id where all else is equal."""
    keys = {
        "color": (difference, -shared, -target), "boundary": (-shared, difference, -target),
        "balanced": (difference - 8.0 * shared / F.greatest(F.lit(1.0), F.sqrt(source)), difference, -shared),
    }
    return F.struct(*[k.cast("double").alias(f"k{i}") for i, k in enumerate(keys[strategy])], region.alias("target"))


def best_targets(pixels: DataFrame, label: str, least: int, strategy: str) -> DataFrame:
    """One round without contraction: every region below ``least`` with the neighbour that it would be merged into."""
    sizes = pixels.groupBy("image_id", F.col(label).alias("region")).agg(F.count(F.lit(1)).alias("size"), F.avg("p").alias("level"))
    edges = grid.adjacency(pixels, label, least=0)
    both = edges.select("image_id", F.explode(F.array(F.struct(F.col("region_a").alias("s"), F.col("region_b").alias("t")), F.struct(F.col("region_b").alias("s"), F.col("region_a").alias("t")))).alias("e"), "boundary_pixels")
    both = both.select("image_id", F.col("e.s").alias("source"), F.col("e.t").alias("target"), "boundary_pixels")
    s = sizes.select("image_id", F.col("region").alias("source"), F.col("size").alias("source_size"), F.col("level").alias("source_level")).where(F.col("source_size") < least)
    t = sizes.select("image_id", F.col("region").alias("target"), F.col("size").alias("target_size"), F.col("level").alias("target_level"))
    met = both.join(s, ["image_id", "source"]).join(t, ["image_id", "target"])
    difference = F.round(F.abs(F.col("source_level") - F.col("target_level")), 9)
    key = strategy_key(strategy, difference, F.col("boundary_pixels"), F.col("source_size"), F.col("target_size"), F.col("target"))
    return met.groupBy("image_id", "source").agg(F.min(key)["target"].alias("target"))
