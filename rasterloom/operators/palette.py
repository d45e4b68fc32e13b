"""Palettes: fitting, assignment, clean-up and superpixel votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.kernels import clean_palette, slic
from rasterloom.session import materialize

#: A palette has at most this many colours, so it is always small enough to send to every task.
MOST_COLOURS = 40


def checked_palette(palette: DataFrame) -> DataFrame:
    """The palette marked for broadcast after its size is checked."""
    if palette.limit(MOST_COLOURS + 1).count() > MOST_COLOURS:
        raise ValueError(f"a palette has at most {MOST_COLOURS} colours")
    return F.broadcast(palette)


def histogram(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels of every palette colour, zero for unused ones."""
    counts = pixels.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return palette.select("palette_index").join(counts, F.col("palette_index") == F.col("p"), "left").select("palette_index", F.coalesce("n", F.lit(0)).alias("pixels"))


def ranked(palette: DataFrame) -> DataFrame:
    """Index by lightness, a, b and old key, from 0, over a palette's few rows."""
    return palette.withColumn("palette_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("l", "a", "b", "key")) - 1)


def nearest(points: DataFrame, palette: DataFrame, features: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Each point's nearest palette row by squared distance; ties take the lowest index. The palette's few rows are literals of one projection: no join, no shuffle."""
    rows = palette.select("palette_index", *features).orderBy("palette_index").limit(MOST_COLOURS + 1).collect()
    if len(rows) > MOST_COLOURS:
        raise ValueError(f"a palette has at most {MOST_COLOURS} colours")
    if not rows:
        return points.select(*keys, F.lit(None).cast("int").alias("palette_index"), F.lit(None).cast("double").alias("distance"))

    def candidate(row) -> Column:
        off = [F.col(f) - F.lit(row[f]) for f in features]
        return F.struct(sum((d * d for d in off[1:]), off[0] * off[0]).alias("d"), F.lit(row["palette_index"]).alias("palette_index"))

    best = F.array_min(F.array(*map(candidate, rows)))
    return points.select(*keys, best.alias("best")).select(*keys, F.col("best.palette_index").alias("palette_index"), F.col("best.d").alias("distance"))


def lloyd_step(points: DataFrame, centres: DataFrame, size: int) -> DataFrame:
    """One step of k-means on array vectors: mean of every centre's nearest points; centres without points stay.

    The centres are few and of fixed size, so they travel as one literal row.
    """
    rows = centres.orderBy("centre").limit(MOST_COLOURS + 1).collect()
    if len(rows) > MOST_COLOURS:
        raise ValueError(f"at most {MOST_COLOURS} centres")

    def distance(values: list[float]) -> Column:
        return F.aggregate(F.zip_with("v", F.array(*map(F.lit, values)), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)

    best = F.least(*[F.struct(distance(r["c"]).alias("d"), F.lit(r["centre"]).alias("centre")) for r in rows])
    labelled = points.select("v", best["centre"].alias("centre"))
    means = labelled.groupBy("centre").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(size)]).alias("mean"), F.count(F.lit(1)).alias("n"))
    return centres.join(F.broadcast(means), "centre", "left").select("centre", F.coalesce("mean", "c").alias("c"), F.coalesce("n", F.lit(0)).alias("n"))


def cleaned(palette: DataFrame, threshold: float, least: int) -> DataFrame:
    """palette_index, new_index and the joined colour of every palette row (columns l, a, b, pixels), per image."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("palette_index")
        colours, new = clean_palette(group[["l", "a", "b"]].to_numpy(), group["pixels"].to_numpy(), threshold, least)
        at = colours[new]
        return pd.DataFrame({"image_id": group["image_id"], "palette_index": group["palette_index"], "new_index": new, "l": at[:, 0], "a": at[:, 1], "b": at[:, 2]})

    return palette.select("image_id", "palette_index", "l", "a", "b", "pixels").groupBy("image_id").applyInPandas(run, "image_id int, palette_index int, new_index int, l double, a double, b double")


def joined_palettes(subject: DataFrame, background: DataFrame) -> DataFrame:
    """Both palettes in one, the background's indices behind the subject's."""
    n = subject.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return subject.select("palette_index", "key").unionByName(background.select((F.col("palette_index") + n).cast("int").alias("palette_index"), "key"))


def superpixel_vote(pixels: DataFrame, label: str) -> DataFrame:
    """Each superpixel's most frequent class; ties take the lowest."""
    counts = pixels.groupBy("image_id", label, "p").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("image_id", label).agg((-F.max(F.struct("n", (-F.col("p")).alias("c")))["c"]).cast("int").alias("winner"))


def superpixels(pixels: DataFrame, segments: int, compactness: float, adaptive: bool = False) -> DataFrame:
    """``superpixel`` of every pixel from its l, a, b, one image at a time."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shape = (int(group["y"].max()) + 1, int(group["x"].max()) + 1, 3)
        lab = np.zeros(shape)
        lab[group["y"], group["x"]] = group[["l", "a", "b"]]
        return group[["image_id", "x", "y"]].assign(superpixel=slic(lab, segments, compactness, adaptive=adaptive)[group["y"], group["x"]])

    return pixels.select("image_id", "x", "y", "l", "a", "b").groupBy("image_id").applyInPandas(run, "image_id int, x int, y int, superpixel long")


def slic_assign(pixels: DataFrame, centres: DataFrame, step: float, compactness: float) -> DataFrame:
    """Each pixel's nearest centre among those within two steps, as a join on grid cells instead of a range join."""
    cell = 2.0 * step
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    spread = centres.select("*", near).select("image_id", "centre", "cx", "cy", "cp", (F.floor(F.col("cx") / cell) + F.col("o.i")).alias("gx"), (F.floor(F.col("cy") / cell) + F.col("o.j")).alias("gy"))
    met = pixels.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)}).join(spread, ["image_id", "gx", "gy"])
    dx, dy, dp = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("p") - F.col("cp")
    met = met.where((F.abs(dx) <= cell) & (F.abs(dy) <= cell))
    cost = dp * dp + (compactness / step) ** 2 * (dx * dx + dy * dy)
    return met.groupBy("image_id", "x", "y").agg(F.min(F.struct(cost.alias("cost"), "centre"))["centre"].alias("centre"))


def slic_centres(pixels: DataFrame, assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """Mean place and class of each centre's pixels; centres without pixels stay."""
    means = pixels.join(assigned, ["image_id", "x", "y"]).groupBy("image_id", "centre").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("p").alias("mp"))
    return centres.join(means, ["image_id", "centre"], "left").select("image_id", "centre", F.coalesce("mx", "cx").alias("cx"), F.coalesce("my", "cy").alias("cy"), F.coalesce("mp", "cp").alias("cp"))
