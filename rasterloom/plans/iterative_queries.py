"""Components, merging, superpixels and fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators import kmeans, merging, parallel_merge, regions, tiles
from rasterloom.operators import palette as pal

from rasterloom.plans.common import Registry, blocks, query, raster, raster_sql, table

QUERIES: Registry = {}
CLASSES, LEAST, SCALE = 3, 12, 0.25
#: Side of the tiles: an image of 100 x 100 pixels has sixteen.
TILE = 32
#: Lab colours of the classes, fixed values.
COLOURS = np.array([[20.0, 10.0, -30.0], [55.0, 40.0, 20.0], [85.0, -5.0, 60.0]])

def _components_sql(diagonal: bool) -> str:
    steps = "(t.x = s.x + 1 AND t.y = s.y) OR (t.x = s.x AND t.y = s.y + 1)" + (" OR (t.x = s.x + 1 AND t.y = s.y + 1) OR (t.x = s.x - 1 AND t.y = s.y + 1)" if diagonal else "")
    return f"""WITH RECURSIVE {raster_sql(CLASSES)}, px AS MATERIALIZED (SELECT image_id * 10000 + y * 100 + x AS id, image_id, x, y, p FROM raster),
 e AS MATERIALIZED (SELECT s.id AS a, t.id AS b FROM px s JOIN px t ON s.image_id = t.image_id AND s.p = t.p AND ({steps})),
 both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 walk(id, label) AS (SELECT id, id FROM px UNION SELECT w.b, walk.label FROM walk JOIN both_ways w ON w.a = walk.id WHERE walk.label < w.b),
 c AS (SELECT id, min(label) AS label FROM walk GROUP BY id), r AS (SELECT label, count(*) AS n FROM c GROUP BY label)
 SELECT CAST(label // 10000 AS INTEGER) AS image_id, count(*) AS regions, max(n) AS largest, min(n) AS smallest FROM r GROUP BY 1"""

def labelled(spark, sf_dir, connectivity: int = 4):
    return regions.connected_regions(raster(spark, sf_dir, CLASSES), connectivity)

def _sizes(rows):
    n = rows.groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("image_id").agg(F.count(F.lit(1)).alias("regions"), F.max("n").alias("largest"), F.min("n").alias("smallest"))

@query(QUERIES, _components_sql(False))
def connected_components_4(spark, sf_dir):
    return _sizes(labelled(spark, sf_dir, 4))

@query(QUERIES, _components_sql(True))
def connected_components_8(spark, sf_dir):
    return _sizes(labelled(spark, sf_dir, 8))

@query(QUERIES, _components_sql(False))
def components_by_propagation(spark, sf_dir):
    """The same components for images that no single task could hold: labels per tile, united over the seams."""
    return _sizes(tiles.components(raster(spark, sf_dir, CLASSES), "p", 4, TILE).withColumnRenamed("component", "region_id"))

@query(QUERIES, _components_sql(True))
def components_over_tiles_8(spark, sf_dir):
    return _sizes(tiles.connected_regions(raster(spark, sf_dir, CLASSES), "p", 8, TILE))

_OUTSIDE_SQL = """{name}_border AS (SELECT image_id, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b FROM raster GROUP BY image_id), {name}_unset AS MATERIALIZED (SELECT image_id, x, y FROM {source} WHERE NOT {mask}),
 {name}_out(image_id, x, y) AS (SELECT image_id, x, y FROM {name}_unset JOIN {name}_border USING (image_id) WHERE x IN (l, r) OR y IN (t, b)
 UNION SELECT u.image_id, u.x, u.y FROM {name}_out o JOIN {name}_unset u ON u.image_id = o.image_id AND abs(u.x - o.x) + abs(u.y - o.y) = 1)"""
_LARGE_SQL = """{name}_px AS MATERIALIZED (SELECT image_id, x, y, image_id * 10000 + y * 100 + x AS id FROM {source} WHERE {mask}),
 {name}_e AS MATERIALIZED (SELECT s.id AS a, t.id AS b FROM {name}_px s JOIN {name}_px t ON s.image_id = t.image_id AND abs(s.x - t.x) + abs(s.y - t.y) = 1),
 {name}_walk(id, label) AS (SELECT id, id FROM {name}_px UNION SELECT e.b, w.label FROM {name}_walk w JOIN {name}_e e ON e.a = w.id WHERE w.label < e.b),
 {name}_c AS (SELECT id, min(label) AS label FROM {name}_walk GROUP BY id),
 {name}_large AS (SELECT image_id, x, y FROM {name}_px JOIN {name}_c USING (id) WHERE label IN (SELECT label FROM {name}_c GROUP BY label HAVING count(*) >= {least}))"""

@query(QUERIES, f"WITH RECURSIVE {raster_sql()}, {_OUTSIDE_SQL.format(name='a', source='raster', mask='mask')} SELECT r.image_id, r.x, r.y, o.x IS NULL AS filled FROM raster r LEFT JOIN a_out o USING (image_id, x, y)")
def fill_holes(spark, sf_dir):
    return tiles.filled(raster(spark, sf_dir), side=TILE).select("image_id", "x", "y", "filled")

def _square_sql(name: str, source: str, rule: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT r.image_id, r.x, r.y, {rule} AS mask FROM {source} r JOIN {source} t ON t.image_id = r.image_id AND abs(t.x - r.x) <= 1 AND abs(t.y - r.y) <= 1 GROUP BY ALL)"

_CLOSED_SQL = ", ".join(_square_sql(name, source, rule) for name, source, rule in (
    ("grown", "raster", "bool_or(t.mask)"), ("shrunk", "grown", "bool_and(t.mask) AND count(*) = 9"), ("regrown", "shrunk", "bool_or(t.mask)"), ("closed", "regrown", "bool_and(t.mask) AND count(*) = 9"),
))

@query(QUERIES, f"WITH {raster_sql()}, {_CLOSED_SQL} SELECT image_id, x, y, mask AS closed FROM closed")
def close_mask_repeated(spark, sf_dir):
    """Dilated and eroded, twice, as masks are cleaned; ``close_mask`` dilates twice before it erodes."""
    return tiles.closed(raster(spark, sf_dir), side=TILE)

@query(QUERIES, f"""WITH RECURSIVE {raster_sql()}, {_CLOSED_SQL}, {_OUTSIDE_SQL.format(name='a', source='closed', mask='mask')},
 full_mask AS (SELECT c.image_id, c.x, c.y, o.x IS NULL AS m FROM closed c LEFT JOIN a_out o USING (image_id, x, y)), {_LARGE_SQL.format(name='b', source='full_mask', mask='m', least=16)}
 SELECT f.image_id, f.x, f.y, CASE WHEN f.image_id IN (SELECT image_id FROM b_large) THEN l.x IS NOT NULL ELSE f.m END AS clean FROM full_mask f LEFT JOIN b_large l USING (image_id, x, y)""")
def clean_mask(spark, sf_dir):
    """Masks closed, filled and without components of under 16 pixels (more in images of over 160,000), where there are others."""
    return tiles.cleaned(raster(spark, sf_dir), side=TILE)

@query(QUERIES, f"WITH RECURSIVE {raster_sql()}, {_LARGE_SQL.format(name='a', source='raster', mask='mask', least=20)} SELECT image_id, x, y FROM a_large")
def keep_large_components(spark, sf_dir):
    """Mask pixels whose component has at least 20 pixels."""
    return tiles.large(raster(spark, sf_dir), "mask", F.lit(20), 4, "kept", TILE).where("kept").select("image_id", "x", "y")

@query(QUERIES)
def merge_small_regions(spark, sf_dir):
    return merging.merge_small_regions(labelled(spark, sf_dir), COLOURS, LEAST)

@query(QUERIES)
def merge_events(spark, sf_dir):
    return merging.merge_log(labelled(spark, sf_dir), COLOURS, LEAST)

@query(QUERIES)
def merge_regions_in_rounds(spark, sf_dir):
    """The merged regions, for images whose regions no single task could hold."""
    return parallel_merge.merge_small_regions(labelled(spark, sf_dir), COLOURS, LEAST, TILE)

@query(QUERIES)
def merge_events_in_rounds(spark, sf_dir):
    """The merges in the queue's order, found in parallel rounds."""
    return parallel_merge.merge_log(labelled(spark, sf_dir), COLOURS, LEAST, side=TILE)

@query(QUERIES)
def strategy_comparison(spark, sf_dir):
    """What each merge strategy makes of every image: one row per image and strategy."""
    return merging.compare(labelled(spark, sf_dir), COLOURS, LEAST, SCALE, 1.5)

@query(QUERIES)
def labelability_pass(spark, sf_dir):
    return merging.labelability(labelled(spark, sf_dir), COLOURS, SCALE, LEAST, 9.0)

@query(QUERIES, f"""WITH {raster_sql()}, o AS (SELECT dx, dy FROM range(-3, 4) a(dx) CROSS JOIN range(-3, 4) b(dy)), d AS (SELECT s.image_id, s.block, s.x, s.y, min(dx * dx + dy * dy) AS d FROM raster s CROSS JOIN o LEFT JOIN raster t ON t.image_id = s.image_id AND t.x = s.x + dx AND t.y = s.y + dy WHERE t.block IS DISTINCT FROM s.block GROUP BY ALL)
 SELECT image_id, block AS region_id, round(2 * sqrt(max(d)) * 0.25, 6) AS max_thickness_mm, 2 * sqrt(max(d)) * 0.25 < 1.6 AS is_thin FROM d GROUP BY ALL""")
def max_thickness(spark, sf_dir):
    pixels = blocks(raster(spark, sf_dir)).withColumn("block", F.col("block").cast("long"))
    out = tiles.thickness(pixels, 0.25, 1.6, "block")
    return out.select("image_id", F.col("region_id").cast("int").alias("region_id"), F.round("max_thickness_mm", 6).alias("max_thickness_mm"), "is_thin")

@query(QUERIES)
def palette_cleanup(spark, sf_dir):
    """Near palette colours joined: every part is a colour, and each run of keys is one image's palette."""
    rgb = color.key_rgb(F.col("p_partkey"))
    image, index = F.floor(F.col("p_partkey") / pal.MOST_COLOURS), F.pmod(F.col("p_partkey"), F.lit(pal.MOST_COLOURS))
    rows = table(spark, sf_dir, "part").select(image.cast("int").alias("image_id"), index.cast("int").alias("palette_index"), F.col("p_size").cast("long").alias("pixels"), *[c.alias(n) for n, c in zip("lab", color.rgb_to_lab(*rgb), strict=True)])
    return pal.cleaned(rows, 12.0, 4)

_STEP, _COMPACT = 10.0, 4.0
_CENTRES_SQL = "centres AS (SELECT DISTINCT image_id, CAST(x // 10 * 10 + 5 AS DOUBLE) AS cx, CAST(y // 10 * 10 + 5 AS DOUBLE) AS cy, CAST((x // 10 + y // 10) % 5 AS DOUBLE) AS cp, CAST(y // 10 * 10 + x // 10 AS INTEGER) AS centre FROM raster)"
_ASSIGN_SQL = f"""WITH {raster_sql()}, {_CENTRES_SQL}, a AS (SELECT image_id, x, y, p, arg_min(centre, (cost, centre)) AS centre FROM (SELECT s.image_id, s.x, s.y, s.p, centre, (p - cp) * (p - cp) + {(_COMPACT / _STEP) ** 2}::DOUBLE * ((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS cost FROM raster s JOIN centres USING (image_id) WHERE abs(x - cx) <= 20 AND abs(y - cy) <= 20) GROUP BY ALL)"""

def _centres(pixels):
    gx, gy = F.floor(F.col("x") / 10), F.floor(F.col("y") / 10)
    return pixels.select("image_id", (gx * 10 + 5).cast("double").alias("cx"), (gy * 10 + 5).cast("double").alias("cy"), ((gx + gy) % 5).cast("double").alias("cp"), (gy * 10 + gx).cast("int").alias("centre")).distinct()

@query(QUERIES, _ASSIGN_SQL + " SELECT image_id, x, y, centre FROM a")
def slic_assign_step(spark, sf_dir):
    pixels = raster(spark, sf_dir)
    return pal.slic_assign(pixels, _centres(pixels), _STEP, _COMPACT).select("image_id", "x", "y", "centre")

@query(QUERIES, _ASSIGN_SQL + ", m AS (SELECT image_id, centre, avg(x) AS mx, avg(y) AS my, avg(p) AS mp FROM a GROUP BY ALL) SELECT c.image_id, c.centre, round(coalesce(mx, cx), 6) AS cx, round(coalesce(my, cy), 6) AS cy, round(coalesce(mp, cp), 6) AS cp FROM centres c LEFT JOIN m ON m.image_id = c.image_id AND m.centre = c.centre")
def slic_centre_update(spark, sf_dir):
    pixels = raster(spark, sf_dir)
    centres = _centres(pixels)
    out = pal.slic_centres(pixels, pal.slic_assign(pixels, centres, _STEP, _COMPACT), centres)
    return out.select("image_id", "centre", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cp")])

_SIZE = 64

@query(QUERIES, """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id AS centre, v AS c FROM v WHERE vec_id < 8), d AS (SELECT vec_id, arg_min(centre, (list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, 65)]), centre)) AS centre FROM v CROSS JOIN c GROUP BY vec_id),
 m AS (SELECT centre, count(*) AS n, avg(v[1]) AS c0, avg(v[64]) AS c63 FROM d JOIN v USING (vec_id) GROUP BY centre) SELECT CAST(centre AS INTEGER) AS centre, n, round(c0, 6) AS c0, round(c63, 6) AS c63 FROM m""")
def kmeans_lloyd_step(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centres = rows.where("vec_id < 8").select(F.col("vec_id").cast("int").alias("centre"), F.col("v").alias("c"))
    return pal.lloyd_step(rows, centres, _SIZE).where("n > 0").select("centre", "n", F.round(F.col("c")[0], 6).alias("c0"), F.round(F.col("c")[63], 6).alias("c63"))

@query(QUERIES)
def kmeans_fit(spark, sf_dir):
    """Eight colours fitted to the parts' colours: the best of ten starts."""
    rgb = color.key_rgb(F.col("p_partkey"))
    points = table(spark, sf_dir, "part").select(F.array(*color.rgb_to_lab(*rgb)).alias("v"))
    return kmeans.fit_centres(points, 8, 3).select("centre", "c")

def _lab_pixels(spark, sf_dir):
    r, g, b = (F.col(c) for c in "rgb")
    rows = raster(spark, sf_dir).withColumns({"r": (F.floor(F.col("x") / 20) * 50).cast("int"), "g": (F.floor(F.col("y") / 20) * 50).cast("int"), "b": F.col("v")})
    return rows.select("image_id", "x", "y", *[c.alias(n) for n, c in zip("lab", color.rgb_to_lab(r, g, b), strict=True)])

@query(QUERIES)
def superpixels_slic(spark, sf_dir):
    return pal.superpixels(_lab_pixels(spark, sf_dir), 60, 10.0)

@query(QUERIES)
def superpixels_adaptive(spark, sf_dir):
    return pal.superpixels(_lab_pixels(spark, sf_dir), 60, 10.0, adaptive=True)

#: Distances up to 8, which no component of these rasters exceeds; a farther one would show as a difference.
_PLACES_SQL = f"""{_components_sql(False).split(" r AS (SELECT label")[0]} named AS MATERIALIZED (SELECT px.*, label FROM px JOIN c USING (id)),
 o AS (SELECT dx, dy FROM range(-8, 9) a(dx) CROSS JOIN range(-8, 9) b(dy)),
 far AS MATERIALIZED (SELECT s.image_id, s.x, s.y, s.p, s.label, min(dx * dx + dy * dy) AS d FROM named s CROSS JOIN o LEFT JOIN named t ON t.image_id = s.image_id AND t.x = s.x + dx AND t.y = s.y + dy WHERE t.label IS DISTINCT FROM s.label GROUP BY ALL),
 middle AS (SELECT image_id, label, avg(x) AS cx, avg(y) AS cy, max(d) AS most FROM far GROUP BY ALL),
 best AS (SELECT f.image_id, f.label, any_value(f.p) AS p, any_value(most) AS most, min(struct_pack(o := (x - cx) * (x - cx) + (y - cy) * (y - cy), y := y, x := x)) AS b FROM far f JOIN middle m USING (image_id, label) WHERE f.d = most GROUP BY ALL)
 SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY p, label) AS region_id, b.x + 0.5::DOUBLE AS x_px, b.y + 0.5::DOUBLE AS y_px, round(sqrt(most), 6) AS distance_px FROM best"""

@query(QUERIES, _PLACES_SQL)
def label_places(spark, sf_dir):
    """Each component's label place."""
    return tiles.label_anchors(labelled(spark, sf_dir)).withColumn("distance_px", F.round("distance_px", 6))

def _colour_pixels(spark, sf_dir):
    """Every events raster as a colour image: fields by place, shaded by what happened there."""
    shade, field = F.col("v") % 24, F.floor(F.col("x") / 25) + 4 * F.floor(F.col("y") / 25)
    rgb = {c: F.least(F.lit(255), (field * k) % 200 + shade).cast("int") for c, k in zip("rgb", (53, 97, 151))}
    return raster(spark, sf_dir).select(F.col("image_id").cast("string").alias("image_id"), "x", "y", *[v.alias(c) for c, v in rgb.items()])

@query(QUERIES)
def synthetic_scene(spark, sf_dir):
    """A drawn scene for every nation, moved by its key: one row per pixel."""
    from rasterloom.sources.scenes import SCENES, scenes

    names = [n for n in SCENES if n != "demo"]
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % len(names) + 1).cast("int"))
    drawn = scenes(spark, tuple(names)).withColumnRenamed("image_id", "scene")
    shade = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("n_nationkey")).cast("int").alias(c)
    return table(spark, sf_dir, "nation").withColumn("scene", kind).join(drawn, "scene").select(F.concat("scene", F.lit("-"), "n_nationkey").alias("image_id"), "x", "y", *map(shade, "rgb"))

@query(QUERIES)
def sheet_strategies(spark, sf_dir):
    """Every raster segmented once and merged by every strategy."""
    from rasterloom.plans.config import Config
    from rasterloom.plans.sheets import compare_strategies

    return compare_strategies(_colour_pixels(spark, sf_dir), Config(superpixels=300)).drop("duration_ms")

@query(QUERIES)
def quality_profiles(spark, sf_dir):
    """The quality gate's metrics of every raster under its two profiles."""
    from rasterloom.plans.config import Config
    from rasterloom.plans.sheets import quality_metrics

    return quality_metrics(_colour_pixels(spark, sf_dir), Config(colors=8, max_side=320, sample_pixels=30000, superpixels=180, min_region_area_mm2=6.0, palette_layout="separate"))

@query(QUERIES)
def sheet_stats(spark, sf_dir):
    """Whole sheets of every raster, as reports."""
    from rasterloom.plans.config import Config
    from rasterloom.plans.sheets import sheets, stats

    return stats(sheets(_colour_pixels(spark, sf_dir), Config(superpixels=300)))
