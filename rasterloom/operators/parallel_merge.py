"""Merging small regions in parallel rounds, with the rows of the queue that takes the smallest first.

The queue takes the region with the smallest key (pixels, id) below the least
size, merges it into the best neighbour and puts the grown target back.  A
region whose key is smaller than all its neighbours' can be merged at once,
whatever the rest of the image does:

* Keys only grow, and what the queue takes before the region has a smaller key,
  so it is none of the region's neighbours.
* Merging something else changes the region's own neighbours, the boundaries that
  they share or the order in which they came only if that is a neighbour.
* With the ``balanced`` strategy the choice depends on nothing but these and on
  colours, which targets keep; sizes of targets do not count.

So the events are those of the queue, and since keys only grow, ordering them by
(source pixels, source id) is the queue's order.  Neighbours are held with the
event that brought them (source pixels, source id, place among the source's
neighbours), which is the order in which the queue would have met them.

A round gives each task the small regions of one tile.  It runs a queue of its
own and holds back every region with a neighbour outside or held back whose key
is smaller.  Then pairs of regions are renamed, and tiles of twice the side
follow, until one tile holds an image: by then only small regions are left that
hang on seams.  Regions of at least the least size never move; a large
background is a name in its neighbours' rows and no group of its own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import tiles
from rasterloom.operators.graph import number_rows
from rasterloom.session import materialize

SIDE = 256
#: A neighbour's order of arrival: the event's source pixels and source id, then the place among the source's neighbours.
_STAMP = ("came_pixels", "came_source", "came_place")
_OUT = (
    "kind string, source long, target long, final long, source_pixels long, shared long, difference double, "
    "came_pixels long, came_source long, came_place long"
)


class _Neighbours(dict):
    """region to (shared boundary, arrival), in order of arrival when asked for."""

    def in_order(self) -> list[int]:
        return sorted(self, key=lambda r: self[r][1])

    def add(self, region: int, shared: int, arrival: tuple[int, int, int]) -> None:
        held = self.get(region)
        self[region] = (shared, arrival) if held is None else (held[0] + shared, min(held[1], arrival))


def run_queue(rows: list[tuple], colours: np.ndarray, least: int) -> tuple[list[tuple], list[tuple]]:
    """One tile's round.

    rows: (region, pixels, class, neighbour, its pixels, its class, whether it is in this tile, shared, arrival).
    Gives events (source, target, final target, source pixels, shared, difference) and the rows
    (region, neighbour, shared, arrival) of the small regions that are left, with what other tiles' regions gain.
    """
    pixels: dict[int, int] = {}
    classes: dict[int, int] = {}
    near: dict[int, _Neighbours] = {}
    outside: dict[int, int] = {}
    for region, n, c, other, other_n, other_c, inside, shared, arrival in rows:
        pixels[region], classes[region] = n, c
        near.setdefault(region, _Neighbours())[other] = (shared, arrival)
        classes[other] = other_c
        if not inside:
            outside[other] = other_n
    gained: dict[int, _Neighbours] = {}
    waiting = [(n, r) for r, n in pixels.items()]
    heapq.heapify(waiting)
    held_back: set[int] = set()
    into: dict[int, int] = {}
    events = []
    while waiting:
        size, source = heapq.heappop(waiting)
        if source in into or source in held_back or pixels[source] != size:
            continue
        own = near[source]
        # what is outside may have grown since, but not shrunk
        if any((outside[r], r) < (size, source) if r in outside else r in held_back and (pixels[r], r) < (size, source) for r in own):
            held_back.add(source)
            continue
        if not own:
            continue
        order = own.in_order()
        best = None
        for r in order:
            difference = float(np.linalg.norm(colours[classes[source]] - colours[classes[r]]))
            key = (difference - 8.0 * own[r][0] / max(1.0, size**0.5), difference, -own[r][0])
            if best is None or key < best[0]:
                best = (key, r, difference)
        _, target, difference = best
        events.append([source, target, None, size, own[target][0], difference])
        into[source] = target
        for place, r in enumerate(order):
            shared = own[r][0]
            if r in near:
                near[r].pop(source)
            elif r in gained:
                gained[r].pop(source, None)
            if r == target:
                continue
            # both sides of the new pair, where a side is small; what another tile holds is told to it
            for one, two, arrival in ((r, target, (size, source, 0)), (target, r, (size, source, place))):
                if one in near:
                    near[one].add(two, shared, arrival)
                elif outside.get(one, least) < least:
                    gained.setdefault(one, _Neighbours()).add(two, shared, arrival)
        if target in pixels:
            pixels[target] += size
            if pixels[target] < least:
                heapq.heappush(waiting, (pixels[target], target))
    for event in events:
        at = event[1]
        while at in into:
            at = into[at]
        event[2] = at
    left = [(r, o, s, a) for table in ({r: n for r, n in near.items() if r not in into}, gained) for r, own in table.items() for o, (s, a) in own.items() if o not in into]
    return [tuple(e) for e in events], left


def _round(pairs: DataFrame, regions: DataFrame, colours: np.ndarray, least: int, side: int) -> DataFrame:
    """Events and rows that are left of every tile."""
    tile = [F.floor(F.col(axis) / side).cast("int") for axis in "xy"]
    own = regions.select("image_id", F.col("region").alias("source"), F.col("pixels").alias("source_pixels"), F.col("p").alias("source_p"), tile[0].alias("tx"), tile[1].alias("ty"))
    other = regions.select("image_id", F.col("region").alias("target"), F.col("pixels").alias("target_pixels"), F.col("p").alias("target_p"), tile[0].alias("target_tx"), tile[1].alias("target_ty"))
    rows = pairs.join(own, ["image_id", "source"]).join(other, ["image_id", "target"])
    inside = (F.col("tx") == F.col("target_tx")) & (F.col("ty") == F.col("target_ty")) & (F.col("target_pixels") < least)
    rows = rows.select("image_id", "tx", "ty", "source", "source_pixels", "source_p", "target", "target_pixels", "target_p", inside.alias("inside"), "shared", *_STAMP)
    names = [f.split()[0] for f in _OUT.split(", ")]
    image = pairs.schema["image_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        columns = [group[c].tolist() for c in ("source", "source_pixels", "source_p", "target", "target_pixels", "target_p", "inside", "shared")]
        arrivals = list(zip(*(group[c].tolist() for c in _STAMP)))
        events, left = run_queue(list(zip(*columns, arrivals)), colours, least)
        made = [("event", s, t, f, n, shared, d, None, None, None) for s, t, f, n, shared, d in events] + [("pair", r, o, None, None, shared, None, *a) for r, o, shared, a in left]
        return pd.DataFrame(made, columns=names, dtype=object).assign(image_id=group["image_id"].iloc[0])

    return rows.groupBy("image_id", "tx", "ty").applyInPandas(run, f"{_OUT}, image_id {image}")


def merge(pixels: DataFrame, colours: np.ndarray, least: int, label: str = "region_id", side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """The events (image_id, source, target, source_pixels, shared, difference) and what became of every region (image_id, region, survivor)."""
    found = pixels.groupBy("image_id", F.col(label).alias("region")).agg(F.count(F.lit(1)).alias("pixels"), F.min("p").alias("p"), F.min("x").alias("x"), F.min("y").alias("y"))
    regions = first = materialize(found.withColumn("pixels", F.col("pixels").cast("long")), "regions")
    small = first.where(F.col("pixels") < least).select("image_id", F.col("region").alias("source"))
    edges = tiles.adjacency(pixels, label, side)
    ends = lambda a, b: edges.select("image_id", F.col(a).alias("source"), F.col(b).alias("target"), F.col("boundary_pixels").alias("shared"))
    both = ends("region_a", "region_b").unionByName(ends("region_b", "region_a")).join(small, ["image_id", "source"])
    # at first neighbours are met by ascending id
    pairs = materialize(both.withColumns({"came_pixels": F.lit(-1).cast("long"), "came_source": F.col("target").cast("long"), "came_place": F.lit(0).cast("long")}), "pairs")
    extent = pixels.agg(F.max(F.greatest("x", "y")).alias("most")).first()["most"] or 0
    events, became = None, None
    while True:
        made = materialize(_round(pairs, regions, colours, least, side), "merge-round")
        new = made.where("kind = 'event'").select("image_id", "source", "target", "final", "source_pixels", "shared", "difference")
        events = new if events is None else events.unionByName(new)
        to = new.select("image_id", F.col("source").alias("region"), F.col("final").alias("to"))
        if became is None:
            became = to
        else:
            onward = to.select("image_id", F.col("region").alias("to"), F.col("to").alias("on"))
            became = became.join(onward, ["image_id", "to"], "left").select("image_id", "region", F.coalesce("on", "to").alias("to")).unionByName(to)
            became = materialize(became, "became")
        if side > extent:
            break
        moved = regions.join(to, ["image_id", "region"], "left").withColumn("at", F.coalesce("to", "region"))
        own = lambda c: F.max(F.when(F.col("at") == F.col("region"), F.col(c))).alias(c)
        regions = materialize(moved.groupBy("image_id", F.col("at").alias("_at")).agg(F.sum("pixels").alias("pixels"), *[own(c) for c in ("p", "x", "y")]).withColumnRenamed("_at", "region"), "regions")
        left = made.where("kind = 'pair'").select("image_id", "source", "target", "shared", *_STAMP)
        # a pair with what another tile has merged is told by that tile under its new name
        gone = to.select("image_id", F.col("region").alias("target"))
        still = regions.where(F.col("pixels") < least).select("image_id", F.col("region").alias("source"))
        stamp = F.min(F.struct(*_STAMP)).alias("came")
        left = left.join(gone, ["image_id", "target"], "left_anti").join(still, ["image_id", "source"]).groupBy("image_id", "source", "target").agg(F.sum("shared").alias("shared"), stamp)
        pairs = materialize(left.select("image_id", "source", "target", "shared", *[F.col(f"came.{c}").alias(c) for c in _STAMP]), "pairs")
        side *= 2
    survivors = first.join(became, ["image_id", "region"], "left").select("image_id", "region", "p", F.coalesce("to", "region").alias("survivor"))
    return events.drop("final"), materialize(survivors, "survivors")


def merge_log(pixels: DataFrame, colours: np.ndarray, least: int, tolerance: float = 35.0, side: int = SIDE) -> DataFrame:
    """The merges of every image in the queue's order."""
    events, survivors = merge(pixels, colours, least, side=side)
    classes = survivors.select("image_id", F.col("region").alias("source"), "p")
    named = events.join(classes.withColumnRenamed("p", "source_p"), ["image_id", "source"]).join(classes.withColumnsRenamed({"p": "target_p", "source": "target"}), ["image_id", "target"])
    return number_rows(named, ["image_id"], ["source_pixels", "source"], "step").select(
        F.col("step").cast("int").alias("step"), F.col("source").alias("source_region"), F.col("target").alias("target_region"), F.col("source_p").alias("source_palette_index"), F.col("target_p").alias("target_palette_index"),
        "source_pixels", F.col("shared").alias("shared_boundary_pixels"), F.col("difference").alias("delta_e76"), (F.col("difference") > tolerance).alias("forced_by_tolerance"), "image_id",
    )


def merge_small_regions(pixels: DataFrame, colours: np.ndarray, least: int, side: int = SIDE) -> DataFrame:
    """Pixels with ``merged_region`` and ``merged_p`` after all regions below ``least`` pixels are merged."""
    _, survivors = merge(pixels, colours, least, side=side)
    kept = survivors.where("region = survivor").select("image_id", "survivor", F.col("p").alias("merged_p"))
    numbered = number_rows(kept, ["image_id"], ["survivor"], "merged_region")
    names = survivors.select("image_id", F.col("region").alias("region_id"), "survivor").join(numbered, ["image_id", "survivor"]).select("image_id", "region_id", "merged_region", "merged_p")
    return pixels.select("image_id", "x", "y", "p", "region_id").join(names, ["image_id", "region_id"]).select("image_id", "x", "y", "p", "region_id", "merged_region", "merged_p")
