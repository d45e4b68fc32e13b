"""Neighbourhood operators on the long pixel table ``(image_id, x, y, ...)``.

Neighbours along an axis come from windows over one row or column of one image.
Square neighbourhoods are separable where the aggregate allows it (minimum,
maximum, sums): one window per axis instead of a join per offset.  Images are
bounded, so no window holds more than one side of an image.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE_SIDE = 100


def row():
    """The window over a pixel row of an image."""
    return Window.partitionBy("image_id", "y").orderBy("x")


def column():
    """The window over a pixel column of an image."""
    return Window.partitionBy("image_id", "x").orderBy("y")


def bind_raster(events: DataFrame, classes: int) -> DataFrame:
    """Events as 100 x 100 images: place from the id, class from the user."""
    area = IMAGE_SIDE * IMAGE_SIDE
    return events.select(
        F.floor(F.col("event_id") / area).cast("int").alias("image_id"), (F.col("event_id") % IMAGE_SIDE).cast("int").alias("x"),
        (F.floor(F.col("event_id") / IMAGE_SIDE) % IMAGE_SIDE).cast("int").alias("y"), (F.col("user_id") % classes).cast("int").alias("p"),
        F.col("event_type").isin("view", "signup").alias("mask"), (F.col("event_id") % 256).cast("int").alias("v"),
    )


def by_image(pixels: DataFrame) -> DataFrame:
    """Bring each image's pixels together, once for all windows over its rows and columns and for aggregates per image."""
    return pixels.repartition("image_id")


def neighbour_pairs(pixels: DataFrame, label: str) -> DataFrame:
    """Each horizontal and vertical pair of neighbours: image_id, a, b."""
    right, below = F.lead(label).over(row()), F.lead(label).over(column())
    both = by_image(pixels).select("image_id", F.col(label).alias("a"), right.alias("right"), below.alias("below"))
    return both.select("image_id", "a", F.explode(F.array("right", "below")).alias("b")).where("b is not null")


def adjacency(pixels: DataFrame, label: str, least: int = 1) -> DataFrame:
    """Undirected edges between different labels with the number of pixel sides that they share."""
    pairs = neighbour_pairs(pixels, label).where((F.col("a") != F.col("b")) & (F.col("a") >= least) & (F.col("b") >= least))
    return pairs.groupBy("image_id", F.least("a", "b").alias("region_a"), F.greatest("a", "b").alias("region_b")).agg(F.count(F.lit(1)).alias("boundary_pixels"))


def boundary_mask(pixels: DataFrame, label: str) -> DataFrame:
    """Pixels with ``boundary``: whether a neighbour along an axis has another label."""
    differs = [F.coalesce(f(label).over(w) != F.col(label), F.lit(False)) for w in (row(), column()) for f in (F.lag, F.lead)]
    return by_image(pixels).withColumn("boundary", differs[0] | differs[1] | differs[2] | differs[3])


def perimeters(pixels: DataFrame, label: str) -> DataFrame:
    """Sides between labels and at the page's border, per label; a corner pixel has two border sides."""
    sides = [F.when(F.coalesce(f(label).over(w) != F.col(label), F.lit(True)), 1).otherwise(0) for w in (row(), column()) for f in (F.lag, F.lead)]
    return by_image(pixels).select("image_id", F.col(label).alias("label"), (sides[0] + sides[1] + sides[2] + sides[3]).alias("sides")).groupBy("image_id", "label").agg(F.sum("sides").alias("perimeter"))


def _axis(window, radius: int):
    return window.rowsBetween(-radius, radius)


def _square(pixels: DataFrame, best, value: str, radius: int, out: str) -> DataFrame:
    return pixels.withColumn(out, best(value).over(_axis(row(), radius))).withColumn(out, best(out).over(_axis(column(), radius)))


def square_max(pixels: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Maximum over the (2r + 1) square; beyond the border the nearest pixel counts, which changes no maximum."""
    return _square(by_image(pixels), F.max, value, radius, out)


def square_min(pixels: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    return _square(by_image(pixels), F.min, value, radius, out)


def cross_dilate(pixels: DataFrame, mask: str, out: str) -> DataFrame:
    """Dilation with the cross of four neighbours; outside counts as unset."""
    near = [F.coalesce(f(mask).over(w), F.lit(False)) for w in (row(), column()) for f in (F.lag, F.lead)]
    return by_image(pixels).withColumn(out, F.col(mask) | near[0] | near[1] | near[2] | near[3])


def cross_erode(pixels: DataFrame, mask: str, out: str) -> DataFrame:
    """Erosion with the cross of four neighbours; outside counts as unset."""
    near = [F.coalesce(f(mask).over(w), F.lit(False)) for w in (row(), column()) for f in (F.lag, F.lead)]
    return by_image(pixels).withColumn(out, F.col(mask) & near[0] & near[1] & near[2] & near[3])


def close_mask(pixels: DataFrame, mask: str, out: str, times: int = 2) -> DataFrame:
    """Closing with the 3 x 3 square: ``times`` dilations, then as many erosions with outside unset."""
    grown = square_max(pixels, mask, times, "_grown")
    # outside counts as unset: pixels within ``times`` of the border are eroded unless the window is whole
    whole = [F.count(F.lit(1)).over(_axis(w, times)) == 2 * times + 1 for w in (row(), column())]
    shrunk = _square(grown, F.min, "_grown", times, "_shrunk")
    return shrunk.withColumn(out, F.col("_shrunk") & whole[0] & whole[1]).drop("_grown", "_shrunk")


def mode_filter(pixels: DataFrame, classes: Sequence[int], radius: int) -> DataFrame:
    """The most frequent class of the (2r + 1) square with border pixels repeated outwards; ties take the lowest class.

    The square's count of a class is separable: windows sum along rows, then
    along columns, with the repeated border added by weight.
    """
    out = by_image(pixels)
    for c in classes:
        out = out.withColumn(f"_n{c}", (F.col("p") == c).cast("int"))
    for window, axis, across in ((row(), "x", "y"), (column(), "y", "x")):
        ends = Window.partitionBy("image_id", across)
        out = out.withColumn("_low", F.greatest(F.lit(0), F.lit(radius) - (F.col(axis) - F.min(axis).over(ends)))).withColumn("_high", F.greatest(F.lit(0), F.lit(radius) - (F.max(axis).over(ends) - F.col(axis))))
        for c in classes:
            # values repeated beyond the border are those of the row's first and last pixel
            first = F.first(f"_n{c}").over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            last = F.last(f"_n{c}").over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            out = out.withColumn(f"_s{c}", F.sum(f"_n{c}").over(_axis(window, radius)) + F.col("_low") * first + F.col("_high") * last)
        for c in classes:
            out = out.withColumn(f"_n{c}", F.col(f"_s{c}")).drop(f"_s{c}")
    counts = F.greatest(*[F.struct(F.col(f"_n{c}").alias("n"), F.lit(-c).alias("c")) for c in classes])
    return out.withColumn("smoothed", (-counts["c"]).cast("int")).drop("_low", "_high", *[f"_n{c}" for c in classes])


def gathered(pixels: DataFrame, value: str, radius: int) -> DataFrame:
    """Pixels with ``near``, all values of the square around each, border pixels repeated: one window per axis."""
    out = by_image(pixels).withColumn("near", F.array(value))
    for window in (row(), column()):
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first("near").over(whole), F.last("near").over(whole)
        shifted = [F.coalesce(F.lag("near", -k).over(window), first) if k < 0 else F.coalesce(F.lead("near", k).over(window), last) if k else F.col("near") for k in range(-radius, radius + 1)]
        out = out.withColumn("near", F.flatten(F.array(*shifted)))
    return out


def median_filter(pixels: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """The median of the (2r + 1) square with border pixels repeated: image_id, x, y, median."""
    middle = F.array_sort("near")[((2 * radius + 1) ** 2 - 1) // 2]
    return gathered(pixels, value, radius).select("image_id", "x", "y", middle.cast("double").alias("median"))


def gaussian(pixels: DataFrame, value: str, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian with mirrored borders, as a weighted window per axis: image_id, x, y, blurred."""
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weights)
    out = by_image(pixels).withColumn("blurred", F.col(value).cast("double"))
    for window, axis, across in ((row(), "x", "y"), (column(), "y", "x")):
        ends = Window.partitionBy("image_id", across)
        out = out.withColumns({"_low": F.col(axis) - F.min(axis).over(ends), "_high": F.max(axis).over(ends) - F.col(axis)})

        def at(k: int, window=window) -> Column:
            return F.lead("blurred", k).over(window) if k > 0 else F.lag("blurred", -k).over(window) if k < 0 else F.col("blurred")

        terms = []
        for k in range(-radius, radius + 1):
            # a place j short of the border sees what is mirrored there
            here, left = at(k), F.col("_high" if k > 0 else "_low")
            for j in range(abs(k)):
                back = 2 * j + 1 - abs(k)
                here = F.when(left == j, at(back if k > 0 else -back)).otherwise(here)
            terms.append(F.lit(weights[k + radius] / total) * F.coalesce(here, F.col("blurred")))
        out = out.withColumn("_sum", sum(terms[1:], terms[0])).withColumn("blurred", F.col("_sum")).drop("_sum", "_low", "_high")
    return out


def resize_nearest(pixels: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Each new pixel takes the old one under its centre: an old pixel gives itself to the new ones that have it there, without a join."""

    def under(axis: str, old: int, new: int) -> Column:
        low = F.floor(F.col(axis) * new / old - 0.5).cast("int")
        near = F.sequence(F.greatest(low, F.lit(0)), F.greatest(F.least(low + new // old + 2, F.lit(new - 1)), F.lit(0)))
        return F.filter(F.when(low <= new - 1, near).otherwise(F.array().cast("array<int>")), lambda n: F.floor((n + 0.5) * old / new) == F.col(axis))

    moved = pixels.withColumns({"_x": under("x", width, new_width), "_y": under("y", height, new_height)}).where((F.size("_x") > 0) & (F.size("_y") > 0))
    spread = moved.withColumn("_x", F.explode("_x")).withColumn("_y", F.explode("_y"))
    return spread.drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})
