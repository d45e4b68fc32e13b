"""Tiled rasters: images of any size as tiles with margins, so that no task holds an image.

A pixel belongs to the tile ``(image_id, _ty, _tx)`` of its place.  For a kernel
that looks ``margin`` pixels far, each pixel also goes to the tiles within that
distance (``with_halo``); a tile runs the kernel on its own part and the margin
and gives back its own part only (``map_tiles``).  At the image's border there is
no margin, so the kernel's rule for borders holds there.

What reaches farther than any margin is done in steps: components are labelled
per tile and united over the seams (``components``), distances are two passes
over whole columns and rows (``distances``), and thinning repeats rounds over
tiles until nothing changes (``thinned``).

Defined cases: pixels that an image lacks are absent in the tile's arrays
(``present`` is false there); an image smaller than a tile is one tile; an empty
table gives no rows; no two rows may have the same place.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from rasterloom.operators import kernels
from rasterloom.operators.graph import contract
from rasterloom.operators.regions import nearest_to_centroid
from rasterloom.session import materialize

#: Pixels along a tile's side.
SIDE = 256
KEY = ("image_id", "_ty", "_tx")
#: Cells of row arrays that a worker handles at once.
ENVELOPE_CELLS = 1 << 20
#: Rounds of one-pixel changes that a tile makes before margins are exchanged again.
THIN_ROUNDS = 8
MOST_THIN_EXCHANGES = 4000

#: From a tile's arrays by column (with its margin) and where the image has pixels, to arrays by new column.
TileKernel = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def tile_of(side: int = SIDE) -> list[Column]:
    return [F.floor(F.col(axis) / side).cast("int").alias(f"_t{axis}") for axis in ("y", "x")]


def with_halo(pixels: DataFrame, margin: int, side: int = SIDE) -> DataFrame:
    """Each pixel once for every tile that needs it, with the tile's key ``_ty``, ``_tx``."""
    reach = lambda axis: F.sequence(F.floor((F.col(axis) - margin) / side).cast("int"), F.floor((F.col(axis) + margin) / side).cast("int"))
    return pixels.withColumn("_ty", F.explode(reach("y"))).withColumn("_tx", F.explode(reach("x")))


def _arrays(group: pd.DataFrame, columns: list[str], y0: int, x0: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    shape = (int(group["y"].max()) - y0 + 1, int(group["x"].max()) - x0 + 1)
    at, present = (group["y"] - y0, group["x"] - x0), np.zeros(shape, bool)
    present[at] = True
    out = {}
    for c in columns:
        out[c] = np.zeros(shape, group[c].dtype)
        out[c][at] = group[c]
    return out, present


def map_tiles(pixels: DataFrame, kernel: TileKernel, columns: list[str], margin: int, out: str, side: int = SIDE) -> DataFrame:
    """image_id, x, y and the columns of ``out`` (a schema) that ``kernel`` makes of the given columns.

    Tiles of places with a margin of ``margin`` equal the kernel on the whole image, if it looks no farther.
    """
    made = StructType.fromDDL(out).fieldNames()
    image = pixels.schema["image_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = (group["y"] // side == group["_ty"]) & (group["x"] // side == group["_tx"])
        if not own.any():  # a margin without a tile
            return pd.DataFrame({"image_id": group["image_id"].iloc[:0], "x": group["x"].iloc[:0], "y": group["y"].iloc[:0]} | {c: [] for c in made})
        y0, x0 = int(group["y"].min()), int(group["x"].min())
        arrays, present = _arrays(group, columns, y0, x0)
        found, kept = kernel(arrays, present), group[own]
        return kept[["image_id", "x", "y"]].assign(**{c: found[c][kept["y"] - y0, kept["x"] - x0] for c in made})

    halo = with_halo(pixels.select("image_id", "x", "y", *columns), margin, side)
    return halo.groupBy(*KEY).applyInPandas(run, f"image_id {image}, x int, y int, {out}")


# --- filters --------------------------------------------------------------------------------------------------------


def gaussian(pixels: DataFrame, value: str, sigma: float, side: int = SIDE) -> DataFrame:
    """Gaussian with mirrored borders: image_id, x, y, blurred."""
    return map_tiles(pixels, lambda a, _: {"blurred": kernels.gaussian(a[value].astype(float), sigma)}, [value], int(4.0 * sigma + 0.5), "blurred double", side)


def _bilateral_reach(sigma_space: float) -> int:
    return max(1, int(math.ceil(3 * sigma_space)) // 2)


def bilateral(pixels: DataFrame, channels: list[str], rounds: list[tuple[float, float]], side: int = SIDE) -> DataFrame:
    """Rounds (sigma of values, sigma of places) of edge-preserving smoothing over all channels; the margin is as wide as all rounds."""

    def kernel(arrays: dict[str, np.ndarray], present: np.ndarray) -> dict[str, np.ndarray]:
        image = np.stack([arrays[c] for c in channels], -1).astype(float)
        for value, space in rounds:
            image = kernels.bilateral(image, value, space)
        return {f"soft_{c}": image[..., i] for i, c in enumerate(channels)}

    return map_tiles(pixels, kernel, channels, sum(_bilateral_reach(s) for _, s in rounds), ", ".join(f"soft_{c} double" for c in channels), side)


# --- components -----------------------------------------------------------------------------------------------------


def _tile_components(pixels: DataFrame, label: str, connectivity: int, side: int, **flags: Column) -> tuple[DataFrame, DataFrame]:
    """The pixels with their tile and its component ``_local``, and each tile's components with ``_root``, the smallest ``_local`` that they are connected with over seams, and ``flags``: aggregates over their pixels.

    Tables with a row a pixel or a component are joined by sorting: their Parquet
    files are far smaller than their rows, so Spark would take them for small and
    have the driver send them out whole.
    """
    names = [f for f in pixels.schema.fields if f.name not in ("_ty", "_tx", "_local", "component")]
    rows = pixels.select([f.name for f in names])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names) + ", _ty int, _tx int, _local long"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(group["y"].min()), int(group["x"].min())
        arrays, present = _arrays(group, [label], y0, x0)
        ids = kernels.label_components(arrays[label], present, connectivity)[group["y"] - y0, group["x"] - x0]
        # a component's first pixel in reading order names it: y in the upper half, x in the lower
        place = group["y"].to_numpy(np.int64) << 32 | group["x"].to_numpy(np.int64)
        first = np.full(int(ids.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, ids, place)
        return group.assign(_local=first[ids])

    local = materialize(rows.select("*", *tile_of(side)).groupBy(*KEY).applyInPandas(run, schema), "tile-components")
    seam = local.where((F.col("y") % side).isin(0, side - 1) | (F.col("x") % side).isin(0, side - 1)).select("image_id", "x", "y", "_ty", "_tx", F.col(label).alias("p"), "_local")
    # only right and lower neighbours are looked for, each once
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if connectivity == 8 else [])
    ahead = seam.select("image_id", "_ty", "_tx", "p", "_local", F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])).alias("at"))
    ahead = ahead.select("image_id", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "p", F.col("_local").alias("a"), F.col("_ty").alias("from_y"), F.col("_tx").alias("from_x"))
    ahead = ahead.where((F.floor(F.col("y") / side) != F.col("from_y")) | (F.floor(F.col("x") / side) != F.col("from_x")))
    met = seam.select("image_id", "x", "y", "p", F.col("_local").alias("b")).hint("merge")
    joined = contract(ahead.join(met, ["image_id", "x", "y", "p"]).select("image_id", "a", "b").distinct())
    # one row for each component of a tile takes part in the join; pixels get theirs by tile
    heads = local.groupBy(*KEY, "_local").agg(*[c.alias(f) for f, c in flags.items()]) if flags else local.select(*KEY, "_local").distinct()
    heads = heads.join(joined.withColumnRenamed("node", "_local").hint("merge"), ["image_id", "_local"], "left")
    return local, heads.select(*KEY, "_local", F.coalesce("component", "_local").alias("_root"), *flags)


def components(pixels: DataFrame, label: str = "p", connectivity: int = 4, side: int = SIDE) -> DataFrame:
    """The pixels with ``component``: the smallest ``y * width + x`` of the pixels of equal label that are connected.

    Every tile labels its own components.  Only pixels at seams meet: their pairs
    make a graph of components, which is contracted; one join by component gives
    the tiles the numbers.  A large background is one node in each tile.
    """
    local, heads = _tile_components(pixels, label, connectivity, side)
    widths = local.groupBy("image_id").agg((F.max("x") + 1).cast("long").alias("_width"))
    number = (F.shiftright("_root", 32) * F.col("_width") + F.col("_root").bitwiseAND(0xFFFFFFFF)).alias("component")
    numbers = heads.join(widths, "image_id").select(*KEY, "_local", number)
    return local.join(numbers.hint("merge"), [*KEY, "_local"]).select(*[c for c in local.columns if c not in ("_ty", "_tx", "_local")], "component")


def connected_regions(pixels: DataFrame, label: str = "p", connectivity: int = 4, side: int = SIDE) -> DataFrame:
    """``region_id`` of every pixel: components numbered by class, then by first pixel, as for whole images.

    Components are numbered over classes; only one row for each of them is ordered.
    """
    found = materialize(components(pixels, label, connectivity, side), "components")
    heads = found.select("image_id", label, "component").distinct()
    # numbers within a class, then the sum of the classes before it: no window holds all components of an image's classes together
    inner = Window.partitionBy("image_id", label).orderBy("component")
    sizes = heads.groupBy("image_id", label).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("image_id").orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("image_id", label, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = heads.withColumn("_number", F.row_number().over(inner)).join(shift, ["image_id", label])
    numbers = numbered.select("image_id", "component", (F.col("_number") + F.col("_before")).cast("long").alias("region_id"))
    return found.join(numbers, ["image_id", "component"]).drop("component")


def large(pixels: DataFrame, mask: str, least: Column, connectivity: int, out: str, side: int = SIDE) -> DataFrame:
    """image_id, x, y and ``out``: whether ``mask`` is set and its component has at least ``least`` pixels (a column that may use ``_pixels``, the image's number of pixels)."""
    at = ["image_id", "x", "y"]
    found = materialize(components(pixels.where(mask).select(*at, mask), mask, connectivity, side), "mask-components")
    sizes = found.groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("_n"))
    whole = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("_pixels"))
    enough = sizes.join(whole, "image_id").where(F.col("_n") >= least).select("image_id", "component")
    kept = found.join(enough, ["image_id", "component"], "left_semi").select(*at, F.lit(True).alias(out))
    return pixels.select(*at).join(kept, at, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def closed(pixels: DataFrame, mask: str = "mask", out: str = "closed", side: int = SIDE) -> DataFrame:
    """image_id, x, y and ``out``: the mask closed with a 3 x 3 square, twice."""
    return map_tiles(pixels, lambda a, _: {out: kernels.close_square(a[mask])}, [mask], 4, f"{out} boolean", side)


def cleaned(pixels: DataFrame, mask: str = "mask", out: str = "clean", side: int = SIDE) -> DataFrame:
    """image_id, x, y and ``out``: the mask closed, filled and without small components, unless an image has no others."""
    whole = materialize(closed(pixels, mask, "_closed", side), "closed")
    full = materialize(filled(whole, "_closed", "_full", side).select("image_id", "x", "y", "_full"), "filled")
    kept = materialize(large(full, "_full", F.greatest(F.lit(16), F.floor(F.col("_pixels") * 0.0001)), 4, "_large", side), "large")
    none = kept.groupBy("image_id").agg((~F.bool_or("_large")).alias("_none"))
    found = full.join(kept, ["image_id", "x", "y"]).join(none, "image_id")
    return found.select("image_id", "x", "y", F.when(F.col("_none"), F.col("_full")).otherwise(F.col("_large")).alias(out))


def adjacency(pixels: DataFrame, label: str, side: int = SIDE) -> DataFrame:
    """image_id, region_a, region_b, boundary_pixels: the sides that two labels share; each tile counts its own pixels' right and lower ones."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = (group["y"] // side == group["_ty"]) & (group["x"] // side == group["_tx"])
        y0, x0 = int(group["y"].min()), int(group["x"].min())
        arrays, present = _arrays(group.assign(_own=own), [label, "_own"], y0, x0)
        labels, pairs = arrays[label].astype(np.int64), []
        for here, there in (((slice(None), slice(0, -1)), (slice(None), slice(1, None))), ((slice(0, -1),), (slice(1, None),))):
            met = arrays["_own"][here] & present[here] & present[there] & (labels[here] != labels[there])
            pairs.append(np.sort(np.stack([labels[here][met], labels[there][met]], 1), axis=1))
        found, counts = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        return pd.DataFrame({"region_a": found[:, 0], "region_b": found[:, 1], "n": counts}).assign(image_id=group["image_id"].iloc[0])

    image = pixels.schema["image_id"].dataType.simpleString()
    counted = with_halo(pixels.select("image_id", "x", "y", label), 1, side).groupBy(*KEY).applyInPandas(run, f"region_a long, region_b long, n long, image_id {image}")
    return counted.groupBy("image_id", "region_a", "region_b").agg(F.sum("n").alias("boundary_pixels"))


# --- edges, thinning and strokes ------------------------------------------------------------------------------------


def canny(pixels: DataFrame, value: str, sigma: float, low: float, high: float, side: int = SIDE, out: str = "edge") -> DataFrame:
    """image_id, x, y and ``out``: crests of the gradient that are strong or connected with strong ones.

    Crests and strength need a margin; which weak crests are kept is decided over the image's components.
    """
    sides = pixels.groupBy("image_id").agg(F.max("x").alias("_right"), F.max("y").alias("_low"))
    graded = map_tiles(pixels, lambda a, _: dict(zip(("crest", "size"), kernels.crests(a[value].astype(float), sigma))), [value], int(4.0 * sigma + 0.5) + 2, "crest boolean, size double", side)
    inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("_right")) & (F.col("y") < F.col("_low"))
    marked = graded.join(sides, "image_id").select("image_id", "x", "y", (F.col("crest") & inner & (F.col("size") >= low)).alias("weak"), (F.col("crest") & inner & (F.col("size") >= high)).alias("strong"))
    local, heads = _tile_components(marked.where("weak"), "weak", 8, side, _strong=F.bool_or("strong"))
    heads = materialize(heads, "crest-components")
    strong = heads.where("_strong").select("image_id", "_root").distinct()
    wanted = heads.join(strong.hint("merge"), ["image_id", "_root"], "left_semi").select(*KEY, "_local")
    kept = local.join(wanted.hint("merge"), [*KEY, "_local"], "left_semi").select("image_id", "x", "y", F.lit(True).alias(out))
    return pixels.select("image_id", "x", "y").join(kept.hint("merge"), ["image_id", "x", "y"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def thinned(pixels: DataFrame, mask: str, out: str = "thin", side: int = SIDE) -> DataFrame:
    """image_id, x, y and ``out``: the mask thinned to a skeleton; tiles make ``THIN_ROUNDS`` rounds before margins meet again.

    A round changes nothing farther than two pixels away, so a margin of twice the rounds keeps a tile's own part right.
    """
    current = materialize(pixels.where(mask).select("image_id", "x", "y"), "strokes")
    for _ in range(MOST_THIN_EXCHANGES):
        step = map_tiles(current, lambda _, present: dict(zip(("kept", "changed"), kernels.thin_rounds(present, THIN_ROUNDS))), [], 2 * THIN_ROUNDS, "kept boolean, changed boolean", side)
        step = materialize(step, "strokes")
        changed = step.where("changed").limit(1).count()
        current = step.where("kept").select("image_id", "x", "y")
        if not changed:
            return pixels.select("image_id", "x", "y").join(current.withColumn(out, F.lit(True)), ["image_id", "x", "y"], "left").withColumn(out, F.coalesce(out, F.lit(False)))
    raise RuntimeError("the strokes did not settle")


def dilated(pixels: DataFrame, mask: str, radius: int, out: str, side: int = SIDE) -> DataFrame:
    """image_id, x, y and ``out``: whether a set pixel is within the disk of that radius."""
    return map_tiles(pixels, lambda a, _: {out: kernels.shift_or(a[mask], kernels.disk_steps(radius))}, [mask], radius, f"{out} boolean", side)


def boundaries(pixels: DataFrame, label: str, out: str, side: int = SIDE) -> DataFrame:
    """image_id, x, y and ``out``: whether a neighbour along an axis has another label."""
    return map_tiles(pixels, lambda a, _: {out: kernels.boundary(a[label])}, [label], 1, f"{out} boolean", side)


def line_art(pixels: DataFrame, gray: str, subject: str, label: str, side: int = SIDE) -> DataFrame:
    """image_id, x, y, stroke: coarse edges, fine ones in and around the subject, none along label boundaries, without specks, thinned."""
    at = ["image_id", "x", "y"]
    soft = materialize(bilateral(pixels, [gray], [(0.045, 2.0)], side), "soft")
    fine, coarse = canny(soft, f"soft_{gray}", 1.05, 0.045, 0.16, side, "fine"), canny(soft, f"soft_{gray}", 2.15, 0.035, 0.13, side, "coarse")
    near = dilated(pixels, subject, 1, "near", side)
    border = dilated(boundaries(pixels, label, "border", side), "border", 1, "edge", side)
    joined = fine.join(coarse, at).join(near, at).join(border, at).select(*at, ((F.col("coarse") | (F.col("fine") & F.col("near"))) & ~F.col("edge")).alias("mark"))
    kept = large(materialize(joined, "marks"), "mark", F.greatest(F.lit(7), F.rint(F.col("_pixels") / 180_000).cast("int")), 8, "solid", side)
    return thinned(kept, "solid", "stroke", side)


# --- holes ----------------------------------------------------------------------------------------------------------


def filled(pixels: DataFrame, mask: str = "mask", out: str = "filled", side: int = SIDE) -> DataFrame:
    """The pixels with ``out``: the mask with what it encloses set, that is every unset component that does not reach the image's border."""
    sides = pixels.groupBy("image_id").agg(F.min("x").alias("_left"), F.max("x").alias("_right"), F.min("y").alias("_top"), F.max("y").alias("_bottom"))
    unset = materialize(components(pixels.where(~F.col(mask)).select("image_id", "x", "y", mask), mask, 4, side), "unset-components")
    at_border = (F.col("x") == F.col("_left")) | (F.col("x") == F.col("_right")) | (F.col("y") == F.col("_top")) | (F.col("y") == F.col("_bottom"))
    outside = unset.join(sides, "image_id").where(at_border).select("image_id", "component").distinct()
    holes = unset.join(outside, ["image_id", "component"], "left_anti").select("image_id", "x", "y", F.lit(True).alias("_hole"))
    return pixels.join(holes, ["image_id", "x", "y"], "left").withColumn(out, F.col(mask) | F.coalesce("_hole", F.lit(False))).drop("_hole")


# --- distances ------------------------------------------------------------------------------------------------------


def _run_steps(at: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For lines (rows of ``labels``) with the same ascending places: the steps to the nearest place behind the ends of each run of equal labels."""
    first = np.ones(labels.shape, bool)
    first[:, 1:] = (labels[:, 1:] != labels[:, :-1]) | (np.diff(at) != 1)
    last = np.roll(first, -1, axis=1)
    last[:, -1] = True
    start = np.maximum.accumulate(np.where(first, at, at[0]), axis=1)
    end = np.minimum.accumulate(np.where(last, at, at[-1])[:, ::-1], axis=1)[:, ::-1]
    return np.minimum(at - start, end - at) + 1


def _by_shape(places: pd.Series, kernel: Callable[[np.ndarray, list[int]], np.ndarray]) -> pd.Series:
    """Apply ``kernel`` (places from 0, numbers of lines) to lines with equal places, a bounded number of cells at once."""
    out: list = [None] * len(places)
    shapes: dict[tuple[int, bytes], list[int]] = {}
    for i, at in enumerate(places):
        shapes.setdefault((len(at), np.asarray(at).tobytes()), []).append(i)
    for members in shapes.values():
        at = np.asarray(places.iloc[members[0]], np.int64)
        at = at - at[0]
        step = max(1, ENVELOPE_CELLS // (int(at[-1]) + 1))
        for k in range(0, len(members), step):
            for i, line in zip(members[k : k + step], kernel(at, members[k : k + step])):
                out[i] = line
    return pd.Series(out)


def _stack(lines: pd.Series, members: list[int]) -> np.ndarray:
    return np.stack([np.asarray(lines.iloc[i]) for i in members])


@F.pandas_udf(ArrayType(LongType()))
def _column_steps(places: pd.Series, labels: pd.Series) -> pd.Series:
    return _by_shape(places, lambda at, members: _run_steps(at, _stack(labels, members)))


@F.pandas_udf(ArrayType(LongType()))
def _row_distances(places: pd.Series, labels: pd.Series, steps: pd.Series) -> pd.Series:
    """Squared distances along rows, from the steps along their columns."""

    def kernel(at: np.ndarray, members: list[int]) -> np.ndarray:
        dense = np.zeros((len(members), int(at[-1]) + 1), np.int64)  # an absent place is one of another label
        dense[:, at] = _stack(steps, members)
        return np.minimum(kernels.row_envelopes(dense)[:, at], _run_steps(at, _stack(labels, members)) ** 2)

    return _by_shape(places, kernel)


def _along(pixels: DataFrame, axis: str, across: str, names: list[str], made: Callable[[Callable[[str], Column]], Column], out: str) -> DataFrame:
    """One pass over one array for each line of an image."""
    held = [c for c in names if c not in ("image_id", axis, across)]
    lines = pixels.groupBy("image_id", across).agg(F.array_sort(F.collect_list(F.struct(axis, *held))).alias("line"))
    found = lines.select("image_id", across, "line", made(lambda c: F.transform("line", lambda p: p[c])).alias("made"))
    single = found.select("image_id", across, F.explode(F.arrays_zip("line", "made")).alias("p"))
    return single.select(*[F.col(c) if c in ("image_id", across) else F.col(f"p.line.{c}").alias(c) for c in names], F.col("p.made").alias(out))


def distances(pixels: DataFrame, label: str) -> DataFrame:
    """The pixels with ``d``: the exact distance to the nearest pixel of another label; what lies outside the image counts as another label.

    One pass for each axis: along columns the steps to the next other label; along
    rows the lower envelope of the parabolas that these steps raise.  Each is over
    one array for each line, so none holds more than some lines of an image.
    """
    names = [c for c in pixels.columns if c not in ("d", "_steps")]
    down = _along(pixels.select(names), "y", "x", names, lambda part: _column_steps(part("y"), part(label)), "_steps")
    far = _along(down, "x", "y", [*names, "_steps"], lambda part: _row_distances(part("x"), part(label), part("_steps")), "d")
    return far.select(*names, F.sqrt(F.col("d").cast("double")).alias("d"))


def thickness(pixels: DataFrame, mm_per_pixel: float, thin_mm: float, label: str = "region_id") -> DataFrame:
    """Per region: the greatest distance from a pixel to the outside, twice over, in millimetres, and whether it is thin."""
    far = distances(pixels, label).groupBy("image_id", F.col(label).alias("region_id")).agg(F.max("d").alias("max_distance_px"))
    width = 2.0 * F.col("max_distance_px") * mm_per_pixel
    return far.select("image_id", "region_id", "max_distance_px", width.alias("max_thickness_mm"), (width < thin_mm).alias("is_thin"))


def label_anchors(pixels: DataFrame, label: str = "region_id") -> DataFrame:
    """Per region the innermost pixel nearest to the centroid, first in reading order, with its distance to the outside."""
    far = distances(pixels.select("image_id", "x", "y", label), label)
    return nearest_to_centroid(materialize(far.withColumnRenamed(label, "region_id"), "distances"))
