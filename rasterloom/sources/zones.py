"""Vector zones as pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ZONES, MOST_POINTS = 64, 12_000
ZONE = "mode string, points array<struct<x: double, y: double>>, radius double"


def parse_zones(requests: DataFrame, column: str) -> DataFrame:
    """Zones of JSON requests with points in 0..1 and a radius within limits; requests with too many zones or points have an ``error``."""
    read = requests.withColumn("zones", F.from_json(F.get_json_object(column, "$.detailZones"), f"array<struct<{ZONE.replace(' string', ': string').replace('points array', 'points: array').replace('radius double', 'radius: double')}>>"))
    total = F.aggregate("zones", F.lit(0), lambda s, z: s + F.coalesce(F.size(z["points"]), F.lit(0)))
    error = F.when(F.size("zones") > MOST_ZONES, "too many zones").when(total > MOST_POINTS, "too many points")
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    clean = F.transform("zones", lambda z: F.struct(z["mode"].alias("mode"), F.transform(F.filter(z["points"], lambda p: p["x"].isNotNull() & p["y"].isNotNull()), lambda p: F.struct(unit(p["x"]).alias("x"), unit(p["y"]).alias("y"))).alias("points"), F.greatest(F.lit(0.006), F.least(F.lit(0.12), F.coalesce(z["radius"], F.lit(0.027)))).alias("radius")))
    return read.withColumn("error", error).withColumn("zones", F.when(F.col("error").isNull(), clean))


def brush_width(radius: Column, width: int, height: int) -> Column:
    return F.greatest(F.lit(8.0), F.rint(radius * min(width, height) * 2.4))


def rasterize(zones: DataFrame, width: int, height: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pixels, on each page that the columns ``by`` name, whose centre is within ``radius`` of a zone's point or line (columns points, radius in pixels).

    Each segment makes the pixels of its own box only, so no zone meets pixels far from it.
    """
    p, q = F.col("e.p"), F.col("e.q")
    both = F.when(F.size("points") == 1, F.array(F.struct(F.col("points")[0].alias("p"), F.col("points")[0].alias("q")))).otherwise(F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: F.struct(a.alias("p"), b.alias("q"))))
    segments = zones.where(F.size("points") > 0).select(*by, "radius", F.explode(both).alias("e")).select(*by, "radius", p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))
    span = lambda a, b, most: F.sequence(F.greatest(F.lit(0), F.floor(F.least(a, b) - F.col("radius")).cast("int")), F.least(F.lit(most - 1), F.ceil(F.greatest(a, b) + F.col("radius")).cast("int")))
    inside = (F.least("ax", "bx") - F.col("radius") <= width) & (F.greatest("ax", "bx") + F.col("radius") >= 0) & (F.least("ay", "by") - F.col("radius") <= height) & (F.greatest("ay", "by") + F.col("radius") >= 0)
    cells = segments.where(inside).withColumn("x", F.explode(span(F.col("ax"), F.col("bx"), width))).withColumn("y", F.explode(span(F.col("ay"), F.col("by"), height)))
    dx, dy, px, py = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x") + 0.5 - F.col("ax"), F.col("y") + 0.5 - F.col("ay")
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.greatest(F.lit(1e-9), dx * dx + dy * dy)))
    off = (px - along * dx) * (px - along * dx) + (py - along * dy) * (py - along * dy)
    return cells.where(off <= F.col("radius") * F.col("radius")).select(*by, "x", "y").distinct()


def fill_polygon(outlines: DataFrame, width: int, height: int) -> DataFrame:
    """Distinct pixels whose centre is inside a closed outline (column points): per pixel row, pixels between crossings."""
    behind = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    edges = F.zip_with("points", behind, lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    rows = outlines.where(F.size("points") >= 3).select(edges.alias("edges"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    mid = F.col("y") + 0.5
    hit = F.filter("edges", lambda e: (e["p"]["y"] <= mid) != (e["q"]["y"] <= mid))
    cross = F.array_sort(F.transform(hit, lambda e: e["p"]["x"] + (mid - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]) / (e["q"]["y"] - e["p"]["y"])))
    spans = rows.select("y", cross.alias("c")).where(F.size("c") >= 2).select("y", "c", F.explode(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2))).alias("i"))
    low, high = F.greatest(F.lit(0), F.ceil(F.col("c")[F.col("i")] - 0.5).cast("int")), F.least(F.lit(width - 1), F.ceil(F.col("c")[F.col("i") + 1] - 0.5).cast("int") - 1)
    return spans.select("y", low.alias("low"), high.alias("high")).where("low <= high").select(F.explode(F.sequence("low", "high")).alias("x"), "y").distinct()
