"""Drawn scenes as pixel tables: discs, boxes and gradients as column expressions over a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, width, height, background and shapes (kind, four numbers, colour); a disc has centre and half axes.
SCENES = {
    "portrait": (180, 220, (188, 211, 218), (("disc", 90, 88, 46, 56, (226, 184, 150)), ("box", 40, 150, 140, 219, (66, 96, 140)), ("disc", 74, 82, 5, 4, (40, 40, 48)), ("disc", 106, 82, 5, 4, (40, 40, 48)))),
    "pet": (220, 170, (176, 205, 150), (("disc", 110, 100, 60, 44, (150, 104, 66)), ("disc", 70, 52, 18, 24, (120, 80, 50)), ("disc", 150, 52, 18, 24, (120, 80, 50)), ("disc", 92, 90, 6, 6, (20, 20, 20)), ("disc", 128, 90, 6, 6, (20, 20, 20)))),
    "object": (240, 170, (235, 229, 214), (("box", 50, 60, 190, 150, (186, 60, 52)), ("disc", 120, 60, 70, 24, (212, 92, 80)), ("box", 112, 24, 128, 60, (90, 70, 50)))),
    "demo": (960, 720, (120, 170, 220), (("box", 0, 430, 959, 719, (96, 150, 88)), ("disc", 760, 150, 80, 80, (250, 214, 96)), ("box", 260, 300, 560, 560, (196, 120, 84)), ("disc", 410, 300, 180, 90, (140, 60, 56)))),
}


def _inside(kind: str, a: float, b: float, c: float, d: float) -> Column:
    x, y = F.col("x"), F.col("y")
    if kind == "box":
        return x.between(a, c) & y.between(b, d)
    return ((x - a) / c) * ((x - a) / c) + ((y - b) / d) * ((y - b) / d) <= 1.0


def scene(spark: SparkSession, name: str) -> DataFrame:
    width, height, background, shapes = SCENES[name]
    pixels = spark.range(width * height).select(F.lit(name).alias("image_id"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    for i, channel in enumerate("rgb"):
        value = F.rint(F.lit(float(background[i])) - 24.0 * F.col("y") / height)
        for kind, *place, colour in shapes:
            value = F.when(_inside(kind, *place), float(colour[i])).otherwise(value)
        pixels = pixels.withColumn(channel, value.cast("int"))
    return pixels


def scenes(spark: SparkSession, names: tuple[str, ...] = ("portrait", "pet", "object")) -> DataFrame:
    out = scene(spark, names[0])
    for name in names[1:]:
        out = out.unionByName(scene(spark, name))
    return out
