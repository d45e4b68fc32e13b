"""Table access, the registry decorator and shared SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import grid

Registry = dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]
#: Colours of the nations' palette: one for each nation.
COLOURS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(registry: Registry, sql: str | None = None, name: str | None = None):
    """Register a query under its function's name with its SQL."""

    def add(run):
        registry[name or run.__name__] = (run, sql)
        return run

    return add


def raster(spark: SparkSession, sf_dir: str, classes: int = 5) -> DataFrame:
    return grid.bind_raster(table(spark, sf_dir, "events"), classes)


def blocks(pixels: DataFrame) -> DataFrame:
    """Add ``block``: the number of the pixel's 5 x 5 block, from 1."""
    return pixels.withColumn("block", (F.floor(F.col("y") / 5) * 20 + F.floor(F.col("x") / 5) + 1).cast("int"))


def rounded(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


def raster_sql(classes: int = 5) -> str:
    return f"""raster AS (SELECT CAST(event_id // 10000 AS INTEGER) AS image_id, CAST(event_id % 100 AS INTEGER) AS x, CAST((event_id // 100) % 100 AS INTEGER) AS y,
      CAST(user_id % {classes} AS INTEGER) AS p, event_type IN ('view', 'signup') AS mask, CAST(event_id % 256 AS INTEGER) AS v,
      CAST(((event_id // 100) % 100) // 5 * 20 + (event_id % 100) // 5 + 1 AS INTEGER) AS block FROM events)"""


def pairs_sql(label: str) -> str:
    return f"""pairs AS (SELECT s.image_id, s.{label} AS a, t.{label} AS b FROM raster s JOIN raster t ON s.image_id = t.image_id AND ((t.x = s.x + 1 AND t.y = s.y) OR (t.x = s.x AND t.y = s.y + 1)))"""


def near_sql(steps: str, kind: str = "LEFT") -> str:
    """Each pixel with its neighbours at the given steps."""
    return f"near AS (SELECT s.image_id, s.x, s.y, s.p, s.block, s.mask, s.v, t.p AS tp, t.block AS tblock, t.mask AS tmask, t.v AS tv FROM raster s CROSS JOIN (VALUES {steps}) o(dx, dy) {kind} JOIN raster t ON t.image_id = s.image_id AND t.x = s.x + o.dx AND t.y = s.y + o.dy)"


CROSS_STEPS = "(1, 0), (-1, 0), (0, 1), (0, -1)"
SQUARE_STEPS = ", ".join(f"({dx}, {dy})" for dy in (-1, 0, 1) for dx in (-1, 0, 1))


def key_rgb_sql(key: str) -> tuple[str, str, str]:
    return tuple(f"(({key} * {k} + {s}) % 256)" for k, s in ((67, 29), (131, 47), (197, 71)))


def lab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    light = [f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)" for c in (r, g, b)]
    rows = ("0.4124564, 0.3575761, 0.1804375", "0.2126729, 0.7151522, 0.0721750", "0.0193339, 0.1191920, 0.9503041")
    bent = []
    for row, white in zip(rows, (0.95047, 1.0, 1.08883)):
        t = "((" + " + ".join(f"{w} * {v}" for w, v in zip(row.split(", "), light)) + f") / {white})"
        bent.append(f"(CASE WHEN {t} > pow(6.0::DOUBLE / 29, 3) THEN cbrt({t}) ELSE {t} / (3 * pow(6.0::DOUBLE / 29, 2)) + 4.0::DOUBLE / 29 END)")
    x, y, z = bent
    return f"(116 * {y} - 16)", f"(500 * ({x} - {y}))", f"(200 * ({y} - {z}))"
