"""Region tables: components, geometry, summaries and the reports built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import grid
from rasterloom.operators.kernels import distance_to_outside, label_components


def connected_regions(pixels: DataFrame, connectivity: int = 4, label: str = "p") -> DataFrame:
    """``region_id`` of every pixel: components of equal class per image, numbered by class, then by first pixel in reading order.

    One image is one group; images are bounded, and there are many of them.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        dense, present = to_dense(group, label)
        ids = label_components(dense, present, connectivity)
        return group.assign(region_id=ids[group["y"], group["x"]].astype(np.int64))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pixels.schema) + ", region_id long"
    return pixels.groupBy("image_id").applyInPandas(run, schema)


def to_dense(group: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A group's column as an image, and where the image has pixels."""
    shape = (int(group["y"].max()) + 1, int(group["x"].max()) + 1)
    dense, present = np.zeros(shape, group[column].dtype), np.zeros(shape, bool)
    dense[group["y"], group["x"]] = group[column]
    present[group["y"], group["x"]] = True
    return dense, present


def region_geometry(pixels: DataFrame, mm_per_pixel: float, min_pixels: int, label: str = "region_id") -> DataFrame:
    """Per region: class, counts, box, centroid, aspect ratio, compactness and the area flag."""
    size = Window.partitionBy("image_id")
    base = pixels.groupBy("image_id", F.col(label).alias("region_id")).agg(
        F.min("p").alias("palette_index"), F.count(F.lit(1)).alias("pixel_count"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
    )
    around = grid.perimeters(pixels, label).withColumnRenamed("label", "region_id")
    wide, high = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    return base.join(around, ["image_id", "region_id"]).select(
        "*", (100.0 * F.col("pixel_count") / F.sum("pixel_count").over(size)).alias("pixel_percent"), (F.col("pixel_count") * mm_per_pixel**2).alias("area_mm2"),
        wide.alias("width"), high.alias("height"), (F.greatest(wide, high) / F.least(wide, high)).alias("aspect_ratio"),
        (4 * math.pi * F.col("pixel_count") / (F.col("perimeter") * F.col("perimeter"))).alias("compactness"), (F.col("pixel_count") < min_pixels).alias("is_below_area_threshold"),
    )


def thickness(pixels: DataFrame, mm_per_pixel: float, thin_mm: float, label: str = "region_id") -> DataFrame:
    """Per region: the greatest distance from a pixel to the outside, twice over, in millimetres, and whether it is thin."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        dense, _ = to_dense(group, label)
        far = distance_to_outside(dense)
        out = pd.DataFrame({"region_id": group[label], "d": far[group["y"], group["x"]]}).groupby("region_id", as_index=False)["d"].max()
        return out.assign(image_id=group["image_id"].iloc[0])[["image_id", "region_id", "d"]]

    far = pixels.groupBy("image_id").applyInPandas(run, "image_id int, region_id long, d double")
    width = 2.0 * F.col("d") * mm_per_pixel
    return far.select("image_id", "region_id", F.col("d").alias("max_distance_px"), width.alias("max_thickness_mm"), (width < thin_mm).alias("is_thin"))


def region_summary(regions: DataFrame) -> DataFrame:
    """One row per image: count, sizes with exact median, and shares below the area threshold."""
    share = lambda c: 100.0 * F.count_if(c) / F.count(F.lit(1))
    return regions.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("regions"), F.min("pixel_count").alias("min_pixels"), F.max("pixel_count").alias("max_pixels"), F.median("pixel_count").alias("median_pixels"), F.min("area_mm2").alias("min_area_mm2"),
        F.count_if(F.col("is_below_area_threshold")).alias("below_count"), share(F.col("is_below_area_threshold")).alias("below_percent"),
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("image_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("image_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("boundary_pixels").alias("total_boundary"))
    joined = n.join(e, "image_id", "left").na.fill(0)
    return joined.select("image_id", "nodes", "edges", (2.0 * F.col("edges") / F.col("nodes")).alias("mean_degree"), "total_boundary")


def size_buckets(regions: DataFrame, limits: tuple[int, ...] = (1, 4, 10, 25, 50, 100)) -> DataFrame:
    """Per limit: regions of at most that many pixels and their share of all pixels (one pass, no join)."""
    sums = [F.count_if(F.col("pixel_count") <= t).alias(f"n{t}") for t in limits] + [F.sum(F.when(F.col("pixel_count") <= t, F.col("pixel_count")).otherwise(0)).alias(f"p{t}") for t in limits]
    wide = regions.groupBy("image_id").agg(F.sum("pixel_count").alias("total"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("at_most"), F.col(f"n{t}").alias("regions"), (100.0 * F.col(f"p{t}") / F.col("total")).alias("pixel_percent")) for t in limits])).alias("b")
    return wide.select("image_id", rows).select("image_id", "b.*")


def mask_majority(pixels: DataFrame, label: str) -> DataFrame:
    """Per label whether at least half of its pixels are in the mask."""
    return pixels.groupBy("image_id", F.col(label).alias("label")).agg((2 * F.count_if("mask") >= F.count(F.lit(1))).alias("is_subject"), F.count_if("mask").alias("mask_pixels"), F.count(F.lit(1)).alias("pixels"))


def thresholds(subject: Column, touched: Column, subject_pixels: int, background_pixels: int, detail_pixels: int) -> Column:
    """A region's own least size: by group, and no more than the detail size where a detail mask touches it."""
    own = F.when(subject, subject_pixels).otherwise(background_pixels)
    return F.when(touched, F.least(own, F.lit(detail_pixels))).otherwise(own)


def label_anchors(pixels: DataFrame, label: str = "region_id") -> DataFrame:
    """Per region the innermost pixel nearest to the centroid, first in reading order, with its distance to the outside."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        dense, _ = to_dense(group, label)
        return group[["image_id", "x", "y", label]].assign(d=distance_to_outside(dense)[group["y"], group["x"]])

    far = pixels.groupBy("image_id").applyInPandas(run, f"image_id int, x int, y int, {label} long, d double")
    return nearest_to_centroid(far.withColumnRenamed(label, "region_id"))


def nearest_to_centroid(placed: DataFrame) -> DataFrame:
    """Among each region's pixels of greatest ``d`` the one nearest to the centroid; ties take the first in reading order."""
    middle = placed.groupBy("image_id", "region_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.max("d").alias("most"))
    near = placed.join(middle, ["image_id", "region_id"]).where(F.abs(F.col("d") - F.col("most")) <= 1e-8 + 1e-5 * F.col("most"))
    off = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    best = near.groupBy("image_id", "region_id").agg(F.min(F.struct(off.alias("off"), "y", "x")).alias("at"), F.max("most").alias("distance_px"))
    return best.select("image_id", "region_id", (F.col("at.x") + 0.5).alias("x_px"), (F.col("at.y") + 0.5).alias("y_px"), "distance_px")


def labelling_summary(placements: DataFrame) -> DataFrame:
    """One row per image from rows (region_id, status, font_size_mm, reason): placed and skipped labels, coverage, reduced fonts and the skipped ids."""
    placed = F.col("status") == "placed"
    return placements.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("region_count"), F.count_if(placed).alias("placed_count"), F.count_if(~placed).alias("skipped_count"), (100.0 * F.count_if(placed) / F.count(F.lit(1))).alias("coverage_percent"),
        F.count_if(placed & (F.col("reason") != "")).alias("reduced_font_count"), F.coalesce(F.min(F.when(placed, F.col("font_size_mm"))), F.lit(0.0)).alias("smallest_font_mm"), F.array_sort(F.collect_list(F.when(~placed, F.col("region_id")))).alias("skipped_region_ids"),
    )


def gate_violations(metrics: DataFrame) -> DataFrame:
    """Rows of metrics that miss the quality gate, with ``violations``: skipped labels, coverage below 100 %, fewer than two colours, no region."""
    checks = [F.when(F.col("skipped_count") != 0, "skipped"), F.when(F.col("coverage_percent") != 100.0, "coverage"), F.when(F.col("actual_colors") < 2, "colors"), F.when(F.col("regions_after") < 1, "regions")]
    return metrics.withColumn("violations", F.array_compact(F.array(*checks))).where(F.size("violations") > 0)
