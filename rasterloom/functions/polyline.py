"""Polylines as arrays of structs (x, y): area, smoothing, simplification and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(points: Column, closed: bool) -> Column:
    """Each point with the one behind it; a closed line's last with its first."""
    behind = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    both = F.zip_with(points, behind, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return both if closed else F.slice(both, 1, F.greatest(F.size(points) - 1, F.lit(0)))


def shoelace_area(points: Column) -> Column:
    crossed = F.transform(_pairs(points, True), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    total = F.aggregate(crossed, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(total) / 2.0)


def _mix(p: Column, q: Column, share: float) -> Column:
    return F.struct((p["x"] * (1 - share) + q["x"] * share).alias("x"), (p["y"] * (1 - share) + q["y"] * share).alias("y"))


def _cut(points: Column, closed: bool) -> Column:
    corners = F.flatten(F.transform(_pairs(points, closed), lambda e: F.array(_mix(e["p"], e["q"], 0.25), _mix(e["p"], e["q"], 0.75))))
    return corners if closed else F.concat(F.slice(points, 1, 1), corners, F.slice(points, -1, 1))


def chaikin(points: Column, iterations: int, closed: bool = True, least_points: int = 3) -> Column:
    """Corner cutting; lines with fewer points stay as they are. Open lines keep their ends."""
    out = points
    for _ in range(iterations):
        out = _cut(out, closed)
    return F.when(F.size(points) < least_points, points).otherwise(out)


def smooth_loop(points: Column, iterations: int, least_area: Column) -> Column:
    """Corner cutting of a closed outline with at least six points and enough area."""
    return F.when(shoelace_area(points) < least_area, points).otherwise(chaikin(points, iterations, True, 6))


def to_page(points: Column, origin_x: Column, origin_y: Column, scale: Column) -> Column:
    return F.transform(points, lambda p: F.struct((origin_x + p["x"] * scale).alias("x"), (origin_y + p["y"] * scale).alias("y")))


def format_number(value: Column) -> Column:
    """Whole numbers without decimals, others with up to three."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", value), "0+$", ""), "[.]$", "")
    return F.when(F.abs(value - F.rint(value)) < 1e-9, F.rint(value).cast("long").cast("string")).otherwise(short)


def svg_path(points: Column, closed: bool) -> Column:
    """``M x y L x y ... Z``."""
    steps = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", format_number(p["x"]), format_number(p["y"]))), " L ")
    return F.when(F.size(points) < 2, "").otherwise(F.concat(F.lit("M "), steps, F.lit(" Z" if closed else "")))
