"""Neighbourhoods, regions, joins, sets and reports on rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import grid, merging, regions, resample
from rasterloom.operators import palette as pal
from rasterloom.plans.common import CROSS_STEPS, SQUARE_STEPS, Registry, blocks, near_sql, pairs_sql, query, raster, raster_sql, rounded, table
from rasterloom.plans.sheet_queries import _REGIONS_SQL, customer_regions

QUERIES: Registry = {}
_XY = ("image_id", "x", "y")


@query(QUERIES, f"WITH {raster_sql()}, {pairs_sql('p')} SELECT image_id, least(a, b) AS region_a, greatest(a, b) AS region_b, count(*) AS boundary_pixels FROM pairs WHERE a <> b GROUP BY ALL")
def region_adjacency(spark, sf_dir):
    """Boundary lengths between the classes of every image."""
    return grid.adjacency(raster(spark, sf_dir), "p", least=0)


@query(QUERIES, f"WITH {raster_sql()}, {near_sql(CROSS_STEPS)} SELECT image_id, p AS label, CAST(sum(CASE WHEN tp IS DISTINCT FROM p THEN 1 ELSE 0 END) AS BIGINT) AS perimeter FROM near GROUP BY ALL")
def perimeter(spark, sf_dir):
    return grid.perimeters(raster(spark, sf_dir), "p")


@query(QUERIES, f"WITH {raster_sql()}, {pairs_sql('p')} SELECT image_id, a, b, count(*) AS n FROM pairs GROUP BY ALL")
def neighbour_pairs(spark, sf_dir):
    """Right and lower neighbours of all pixels in one table."""
    return grid.neighbour_pairs(raster(spark, sf_dir), "p").groupBy("image_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(QUERIES, f"""WITH {raster_sql()}, {near_sql(CROSS_STEPS)}, per AS (SELECT image_id, block, sum(CASE WHEN tblock IS DISTINCT FROM block THEN 1 ELSE 0 END) AS perimeter FROM near GROUP BY ALL),
 g AS (SELECT image_id, block, min(p) AS palette_index, count(*) AS pixel_count, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, avg(x) AS cx, avg(y) AS cy FROM raster GROUP BY ALL)
 SELECT image_id, block AS region_id, palette_index, pixel_count, round(100.0 * pixel_count / sum(pixel_count) OVER (PARTITION BY image_id), 6) AS pixel_percent, round(pixel_count * 0.0625, 6) AS area_mm2, min_x, min_y, max_x, max_y, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y,
 CAST(perimeter AS BIGINT) AS perimeter, round(greatest(max_x - min_x + 1, max_y - min_y + 1) / least(max_x - min_x + 1, max_y - min_y + 1)::DOUBLE, 6) AS aspect_ratio, round(4 * pi() * pixel_count / (perimeter * perimeter), 6) AS compactness, pixel_count < 25 AS is_below_area_threshold FROM g JOIN per USING (image_id, block)""")
def region_geometry(spark, sf_dir):
    out = regions.region_geometry(blocks(raster(spark, sf_dir)), 0.25, 25, "block")
    return out.select("image_id", "region_id", "palette_index", "pixel_count", *rounded("pixel_percent", "area_mm2"), "min_x", "min_y", "max_x", "max_y", *rounded("centroid_x", "centroid_y"), "perimeter", *rounded("aspect_ratio", "compactness"), "is_below_area_threshold")


def flagged(spark, sf_dir) -> DataFrame:
    return customer_regions(spark, sf_dir).withColumn("is_below_area_threshold", F.col("pixel_count") < 8)


@query(QUERIES, f"WITH {_REGIONS_SQL} SELECT image_id, count(*) AS regions, min(pixel_count) AS min_pixels, max(pixel_count) AS max_pixels, median(pixel_count) AS median_pixels, round(min(area_mm2), 6) AS min_area_mm2, count(CASE WHEN pixel_count < 8 THEN 1 END) AS below_count, round(100.0 * count(CASE WHEN pixel_count < 8 THEN 1 END) / count(*), 6) AS below_percent FROM regions GROUP BY image_id")
def region_summary(spark, sf_dir):
    out = regions.region_summary(flagged(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("min_area_mm2", "below_percent")})


@query(QUERIES, f"WITH {raster_sql()}, {pairs_sql('block')}, e AS (SELECT image_id, least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM pairs WHERE a <> b GROUP BY ALL), n AS (SELECT image_id, count(DISTINCT block) AS nodes FROM raster GROUP BY image_id), s AS (SELECT image_id, count(*) AS edges, sum(n) AS total FROM e GROUP BY image_id) SELECT image_id, nodes, edges, round(2.0 * edges / nodes, 6) AS mean_degree, CAST(total AS BIGINT) AS total_boundary FROM n JOIN s USING (image_id)")
def graph_summary(spark, sf_dir):
    pixels = blocks(raster(spark, sf_dir))
    out = regions.graph_summary(pixels.select("image_id", "block").distinct(), grid.adjacency(pixels, "block"))
    return out.withColumn("mean_degree", F.round("mean_degree", 6))


@query(QUERIES, f"WITH {_REGIONS_SQL}, t AS (SELECT unnest([1, 4, 10, 25, 50, 100]) AS at_most) SELECT image_id, at_most, count(CASE WHEN pixel_count <= at_most THEN 1 END) AS regions, round(100.0 * coalesce(sum(CASE WHEN pixel_count <= at_most THEN pixel_count END), 0) / sum(pixel_count), 6) AS pixel_percent FROM regions CROSS JOIN t GROUP BY image_id, at_most")
def size_buckets(spark, sf_dir):
    return regions.size_buckets(customer_regions(spark, sf_dir)).withColumn("pixel_percent", F.round("pixel_percent", 6))


@query(QUERIES, f"WITH {raster_sql()} SELECT image_id, block AS label, 2 * sum(mask::INT) >= count(*) AS is_subject, CAST(sum(mask::INT) AS BIGINT) AS mask_pixels, count(*) AS pixels FROM raster GROUP BY ALL")
def subject_majority(spark, sf_dir):
    return regions.mask_majority(blocks(raster(spark, sf_dir)), "block")


@query(QUERIES, f"WITH {raster_sql()}, g AS (SELECT image_id, block, count(*) AS n, 2 * sum(mask::INT) >= count(*) AS s, bool_or(v < 8) AS touched FROM raster GROUP BY ALL), t AS (SELECT *, CASE WHEN touched THEN least(CASE WHEN s THEN 20 ELSE 30 END, 10) ELSE CASE WHEN s THEN 20 ELSE 30 END END AS least_pixels FROM g) SELECT image_id, count(CASE WHEN s AND n < least_pixels THEN 1 END) AS subject_violations, count(CASE WHEN NOT s AND n < least_pixels THEN 1 END) AS background_violations FROM t GROUP BY image_id")
def split_violations(spark, sf_dir):
    """Regions below their own group's least size; a detail mask lowers it where it touches."""
    g = blocks(raster(spark, sf_dir)).groupBy("image_id", "block").agg(F.count(F.lit(1)).alias("n"), (2 * F.count_if("mask") >= F.count(F.lit(1))).alias("s"), F.bool_or(F.col("v") < 8).alias("touched"))
    small = F.col("n") < regions.thresholds(F.col("s"), F.col("touched"), 20, 30, 10)
    return g.groupBy("image_id").agg(F.count_if(F.col("s") & small).alias("subject_violations"), F.count_if(~F.col("s") & small).alias("background_violations"))


@query(QUERIES, f"WITH {raster_sql()} SELECT image_id, count(CASE WHEN p <> v % 5 THEN 1 END) AS recolored, round(100.0 * count(CASE WHEN p <> v % 5 THEN 1 END) / count(*), 6) AS percent FROM raster GROUP BY image_id")
def recolored_pixels(spark, sf_dir):
    changed = F.count_if(F.col("p") != F.col("v") % 5)
    return raster(spark, sf_dir).groupBy("image_id").agg(changed.alias("recolored"), F.round(100.0 * changed / F.count(F.lit(1)), 6).alias("percent"))


@query(QUERIES, f"WITH {raster_sql()}, c AS (SELECT image_id, block, p, count(*) AS n FROM raster GROUP BY ALL) SELECT image_id, block, CAST(arg_max(p, n * 100 - p) AS INTEGER) AS winner FROM c GROUP BY image_id, block")
def superpixel_vote(spark, sf_dir):
    return pal.superpixel_vote(blocks(raster(spark, sf_dir)), "block")


@query(QUERIES, f"WITH {raster_sql()}, c AS (SELECT image_id, block, p, count(*) AS n FROM raster GROUP BY ALL), w AS (SELECT image_id, block, arg_max(p, n * 100 - p) AS winner FROM c GROUP BY image_id, block) SELECT image_id, winner, count(*) AS pixels FROM raster JOIN w USING (image_id, block) GROUP BY ALL")
def vote_applied(spark, sf_dir):
    """Every pixel takes its superpixel's class; counted by class."""
    pixels = blocks(raster(spark, sf_dir))
    return pixels.join(pal.superpixel_vote(pixels, "block"), ["image_id", "block"]).groupBy("image_id", "winner").agg(F.count(F.lit(1)).alias("pixels"))


# --- neighbourhoods -------------------------------------------------------------------------------------------------

_MODE_SQL = """size AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM raster GROUP BY image_id),
 near AS (SELECT s.image_id, s.x, s.y, t.p FROM raster s JOIN size USING (image_id) CROSS JOIN range(-1, 2) dx(dx) CROSS JOIN range(-1, 2) dy(dy) JOIN raster t ON t.image_id = s.image_id AND t.x = greatest(0, least(mx, s.x + dx)) AND t.y = greatest(0, least(my, s.y + dy))),
 c AS (SELECT image_id, x, y, p, count(*) AS n FROM near GROUP BY ALL)"""


@query(QUERIES, f"WITH {raster_sql(3)}, {_MODE_SQL} SELECT image_id, x, y, CAST(arg_max(p, n * 100 - p) AS INTEGER) AS smoothed FROM c GROUP BY image_id, x, y")
def mode_filter(spark, sf_dir):
    return grid.mode_filter(raster(spark, sf_dir, 3), (0, 1, 2), 1).select(*_XY, "smoothed")


@query(QUERIES, f"WITH {raster_sql()}, {near_sql(CROSS_STEPS)} SELECT image_id, x, y, mask OR bool_or(coalesce(tmask, false)) AS grown FROM near GROUP BY image_id, x, y, mask")
def dilate(spark, sf_dir):
    return grid.cross_dilate(raster(spark, sf_dir), "mask", "grown").select(*_XY, "grown")


@query(QUERIES, f"WITH {raster_sql()}, {near_sql(CROSS_STEPS)} SELECT image_id, x, y, mask AND bool_and(coalesce(tmask, false)) AS shrunk FROM near GROUP BY image_id, x, y, mask")
def erode(spark, sf_dir):
    return grid.cross_erode(raster(spark, sf_dir), "mask", "shrunk").select(*_XY, "shrunk")


_SQUARE = f"CROSS JOIN (VALUES {SQUARE_STEPS}) o(dx, dy)"


@query(QUERIES, f"""WITH {raster_sql()}, g AS (SELECT s.image_id, s.x, s.y, bool_or(coalesce(t.mask, false)) AS m FROM raster s {_SQUARE} LEFT JOIN raster t ON t.image_id = s.image_id AND t.x = s.x + dx AND t.y = s.y + dy GROUP BY ALL),
 h AS (SELECT s.image_id, s.x, s.y, bool_or(coalesce(t.m, false)) AS m FROM g s {_SQUARE} LEFT JOIN g t ON t.image_id = s.image_id AND t.x = s.x + dx AND t.y = s.y + dy GROUP BY ALL),
 i AS (SELECT s.image_id, s.x, s.y, bool_and(coalesce(t.m, false)) AS m FROM h s {_SQUARE} LEFT JOIN h t ON t.image_id = s.image_id AND t.x = s.x + dx AND t.y = s.y + dy GROUP BY ALL)
 SELECT s.image_id, s.x, s.y, bool_and(coalesce(t.m, false)) AS closed FROM i s {_SQUARE} LEFT JOIN i t ON t.image_id = s.image_id AND t.x = s.x + dx AND t.y = s.y + dy GROUP BY ALL""")
def close_mask(spark, sf_dir):
    return grid.close_mask(raster(spark, sf_dir), "mask", "closed").select(*_XY, "closed")


@query(QUERIES, f"WITH {raster_sql()}, {near_sql(SQUARE_STEPS)} SELECT image_id, x, y, max(tv) AS largest FROM near GROUP BY image_id, x, y")
def max_filter(spark, sf_dir):
    return grid.square_max(raster(spark, sf_dir), "v", 1, "largest").select(*_XY, "largest")


@query(QUERIES, f"WITH {raster_sql()}, size AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM raster GROUP BY image_id) SELECT s.image_id, s.x, s.y, median(t.v) AS median FROM raster s JOIN size USING (image_id) {_SQUARE} JOIN raster t ON t.image_id = s.image_id AND t.x = greatest(0, least(mx, s.x + dx)) AND t.y = greatest(0, least(my, s.y + dy)) GROUP BY s.image_id, s.x, s.y")
def median_filter(spark, sf_dir):
    return grid.median_filter(raster(spark, sf_dir), "v")


@query(QUERIES, f"WITH {raster_sql()}, {near_sql(CROSS_STEPS)} SELECT image_id, x, y, bool_or(coalesce(tp <> p, false)) AS boundary FROM near GROUP BY image_id, x, y")
def boundary_mask(spark, sf_dir):
    return grid.boundary_mask(raster(spark, sf_dir), "p").select(*_XY, "boundary")


@query(QUERIES, f"WITH {raster_sql()}, {near_sql(CROSS_STEPS)}, b AS (SELECT image_id, x, y, bool_or(coalesce(tp <> p, false)) AS b FROM near GROUP BY ALL) SELECT s.image_id, s.x, s.y, bool_or(t.b) AS thick FROM b s {_SQUARE} JOIN b t ON t.image_id = s.image_id AND t.x = s.x + dx AND t.y = s.y + dy GROUP BY ALL")
def thick_boundary(spark, sf_dir):
    """Boundary drawn two pixels wide."""
    return grid.square_max(grid.boundary_mask(raster(spark, sf_dir), "p"), "boundary", 1, "thick").select(*_XY, "thick")




@query(QUERIES, f"""WITH {raster_sql()}, w AS (SELECT k, exp(-0.5::DOUBLE * pow(k / 0.65::DOUBLE, 2)) / sum(exp(-0.5::DOUBLE * pow(k / 0.65::DOUBLE, 2))) OVER () AS w FROM range(-3, 4) r(k)), size AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM raster GROUP BY image_id),
 a AS (SELECT s.image_id, s.x, s.y, sum(w * t.v) AS b FROM raster s JOIN size USING (image_id) CROSS JOIN w JOIN raster t ON t.image_id = s.image_id AND t.y = s.y AND t.x = CASE WHEN s.x + k < 0 THEN -(s.x + k) - 1 WHEN s.x + k > mx THEN 2 * mx + 1 - s.x - k ELSE s.x + k END GROUP BY ALL)
 SELECT s.image_id, s.x, s.y, round(sum(w * t.b), 4) AS blurred FROM a s JOIN size USING (image_id) CROSS JOIN w JOIN a t ON t.image_id = s.image_id AND t.x = s.x AND t.y = CASE WHEN s.y + k < 0 THEN -(s.y + k) - 1 WHEN s.y + k > my THEN 2 * my + 1 - s.y - k ELSE s.y + k END GROUP BY ALL""")
def gaussian_blur(spark, sf_dir):
    return grid.gaussian(raster(spark, sf_dir), "v", 0.65).select(*_XY, F.round("blurred", 4).alias("blurred"))


@query(QUERIES, f"WITH {raster_sql()}, n AS (SELECT DISTINCT image_id FROM raster), g AS (SELECT image_id, CAST(i % 40 AS INTEGER) AS nx, CAST(i // 40 AS INTEGER) AS ny FROM n CROSS JOIN range(1600) r(i)) SELECT g.image_id, nx AS x, ny AS y, v FROM g JOIN raster t ON t.image_id = g.image_id AND t.x = CAST(floor((nx + 0.5) * 100 / 40) AS INTEGER) AND t.y = CAST(floor((ny + 0.5) * 100 / 40) AS INTEGER)")
def resize_nearest(spark, sf_dir):
    return grid.resize_nearest(raster(spark, sf_dir).select(*_XY, "v"), 100, 100, 40, 40).select("image_id", "x", "y", "v")


def _resized_sql(curve: str, support: int, width: int, height: int) -> str:
    weights = lambda name, axis, new: f"""{name} AS MATERIALIZED (SELECT image_id, n, o, w / sum(w) OVER (PARTITION BY image_id, n) AS w FROM (SELECT image_id, n, o, {curve} AS w FROM (
  SELECT image_id, n, o, (o - centre + 0.5) / wide AS t FROM (SELECT *, unnest(range(CAST(greatest(0, trunc(centre - {support} * wide + 0.5)) AS BIGINT), CAST(least(old, trunc(centre + {support} * wide + 0.5)) AS BIGINT))) AS o FROM (
  SELECT image_id, n, old, (n + 0.5) * old / {new} AS centre, greatest(old / {new}::DOUBLE, 1.0) AS wide FROM (SELECT image_id, max({axis}) + 1 AS old FROM raster GROUP BY image_id), range({new}) r(n))))))"""  # noqa: E731
    return f"""WITH {raster_sql()}, {weights('wx', 'x', width)}, {weights('wy', 'y', height)},
 across AS MATERIALIZED (SELECT r.image_id, r.y, wx.n AS x, sum(r.v * w) AS v FROM raster r JOIN wx ON wx.image_id = r.image_id AND wx.o = r.x GROUP BY ALL)
 SELECT a.image_id, CAST(a.x AS INTEGER) AS x, CAST(wy.n AS INTEGER) AS y, round(sum(a.v * w), 4) AS v FROM across a JOIN wy ON wy.image_id = a.image_id AND wy.o = a.y GROUP BY ALL"""


_SINC = "(CASE WHEN {0} = 0 THEN 1.0 ELSE sin(pi() * {0}) / (pi() * {0}) END)"


@query(QUERIES, _resized_sql(f"CASE WHEN abs(t) < 3 THEN {_SINC.format('t')} * {_SINC.format('(t / 3)')} ELSE 0.0 END", 3, 61, 37))
def resize_lanczos(spark, sf_dir):
    """Every raster made smaller by a windowed sinc."""
    return resample.resized(raster(spark, sf_dir), "v", 61, 37, "lanczos").withColumn("v", F.round("v", 4))


@query(QUERIES, _resized_sql("greatest(0.0, 1.0 - abs(t))", 1, 130, 40))
def resize_triangle(spark, sf_dir):
    """Every raster made wider and lower by linear weights."""
    return resample.resized(raster(spark, sf_dir), "v", 130, 40, "triangle").withColumn("v", F.round("v", 4))


# --- windows and joins ----------------------------------------------------------------------------------------------


@query(QUERIES, f"WITH {raster_sql()} SELECT image_id, x, y, lead(p) OVER (PARTITION BY image_id, y ORDER BY x) AS right_p, lead(p) OVER (PARTITION BY image_id, x ORDER BY y) AS below_p FROM raster")
def neighbour_access(spark, sf_dir):
    return raster(spark, sf_dir).select(*_XY, F.lead("p").over(grid.row()).alias("right_p"), F.lead("p").over(grid.column()).alias("below_p"))


@query(QUERIES, "SELECT c_nationkey AS image_id, c_custkey AS old_id, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS new_id FROM customer")
def dense_reid(spark, sf_dir):
    own = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image_id"), F.col("c_custkey").alias("old_id"), F.dense_rank().over(own).alias("new_id"))


@query(QUERIES, "WITH l AS (SELECT l_suppkey AS image_id, 1 AS phase, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey, 2, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') SELECT image_id, phase, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY image_id ORDER BY phase, l_orderkey, l_linenumber) AS INTEGER) AS step FROM l")
def merge_log_union(spark, sf_dir):
    """The logs of two phases in one, steps counted on."""
    lines = table(spark, sf_dir, "lineitem")
    one, two = (lines.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("image_id"), F.lit(i).alias("phase"), "l_orderkey", "l_linenumber") for i, flag in ((1, "R"), (2, "A")))
    own = Window.partitionBy("image_id").orderBy("phase", "l_orderkey", "l_linenumber")
    return one.unionByName(two).withColumn("step", F.row_number().over(own))


def _best_sql(key: str) -> str:
    return f"""WITH {raster_sql()}, {pairs_sql('block')}, e AS (SELECT image_id, least(a, b) AS ra, greatest(a, b) AS rb, count(*) AS n FROM pairs WHERE a <> b GROUP BY ALL),
 s AS (SELECT image_id, block, count(*) AS size, avg(p) AS level FROM raster GROUP BY ALL), b AS (SELECT image_id, ra AS source, rb AS target, n FROM e UNION ALL SELECT image_id, rb, ra, n FROM e),
 c AS (SELECT b.image_id, source, target, n, round(abs(u.level - w.level), 9) AS d, u.size AS ss, w.size AS ts FROM b JOIN s u ON u.image_id = b.image_id AND u.block = source JOIN s w ON w.image_id = b.image_id AND w.block = target WHERE u.size < 26)
 SELECT image_id, source, target FROM (SELECT *, row_number() OVER (PARTITION BY image_id, source ORDER BY {key}, target) AS r FROM c) WHERE r = 1"""


for _strategy, _key in (("color", "d, -n, -ts"), ("boundary", "-n, d, -ts"), ("balanced", "d - 8.0::DOUBLE * n / greatest(1.0, sqrt(ss)), d, -n")):

    @query(QUERIES, _best_sql(_key), f"merge_best_target_{_strategy}")
    def _best_target(spark, sf_dir, strategy=_strategy):
        return merging.best_targets(blocks(raster(spark, sf_dir)), "block", 26, strategy)


@query(QUERIES, f"WITH {raster_sql()}, c AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy, least(x % 5 + 1, 5 - x % 5, y % 5 + 1, 5 - y % 5) AS d FROM raster WINDOW w AS (PARTITION BY image_id, block)), m AS (SELECT *, max(d) OVER (PARTITION BY image_id, block) AS md FROM c) SELECT image_id, block AS region_id, x + 0.5::DOUBLE AS x_px, y + 0.5::DOUBLE AS y_px, CAST(md AS DOUBLE) AS distance_px FROM (SELECT *, row_number() OVER (PARTITION BY image_id, block ORDER BY pow(x - cx, 2) + pow(y - cy, 2), y, x) AS r FROM m WHERE d = md) WHERE r = 1")
def label_anchor(spark, sf_dir):
    """Each block's innermost pixel nearest to its middle."""
    d = F.least(F.col("x") % 5 + 1, 5 - F.col("x") % 5, F.col("y") % 5 + 1, 5 - F.col("y") % 5).cast("double")
    return regions.nearest_to_centroid(blocks(raster(spark, sf_dir)).select(*_XY, F.col("block").alias("region_id"), d.alias("d")))


@query(QUERIES, f"WITH {raster_sql()} SELECT image_id, block, min(y * 1000 + x) AS first_pixel FROM raster WHERE mask GROUP BY ALL")
def first_candidate(spark, sf_dir):
    """The first set pixel of every block in reading order."""
    first = F.min(F.struct("y", "x")).alias("f")
    return blocks(raster(spark, sf_dir)).where("mask").groupBy("image_id", "block").agg(first).select("image_id", "block", (F.col("f.y") * 1000 + F.col("f.x")).alias("first_pixel"))


@query(QUERIES, f"WITH {raster_sql()} SELECT DISTINCT image_id, block FROM raster r WHERE EXISTS (SELECT 1 FROM raster m WHERE m.image_id = r.image_id AND m.block = r.block AND m.v < 8)")
def mask_semi_join(spark, sf_dir):
    """Blocks that a mask touches."""
    pixels = blocks(raster(spark, sf_dir)).select("image_id", "block", "v")
    return pixels.select("image_id", "block").distinct().join(pixels.where("v < 8"), ["image_id", "block"], "left_semi")


@query(QUERIES, f"WITH {raster_sql()}, {near_sql(CROSS_STEPS)}, b AS (SELECT image_id, x, y, mask, bool_or(coalesce(tp <> p, false)) AS b FROM near GROUP BY ALL) SELECT image_id, x, y FROM b WHERE mask AND NOT b")
def boundary_anti_join(spark, sf_dir):
    """Mask pixels that lie on no boundary; the boundary is known on the pixel itself, so no join is needed."""
    return grid.boundary_mask(raster(spark, sf_dir), "p").where("mask and not boundary").select(*_XY)


@query(QUERIES, f"WITH {raster_sql()}, k AS (SELECT image_id, block FROM raster WHERE mask GROUP BY ALL HAVING count(*) >= 12) SELECT image_id, x, y FROM raster JOIN k USING (image_id, block) WHERE mask")
def keep_components(spark, sf_dir):
    """Mask pixels of the blocks that hold enough of them."""
    pixels = blocks(raster(spark, sf_dir)).where("mask").select(*_XY, "block")
    large = pixels.groupBy("image_id", "block").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    return pixels.join(large, ["image_id", "block"], "left_semi").select(*_XY)


@query(QUERIES, f"WITH {raster_sql(25)}, {pairs_sql('p')}, e AS (SELECT image_id, least(a, b) AS region_a, greatest(a, b) AS region_b, count(*) AS n FROM pairs WHERE a <> b GROUP BY ALL) SELECT image_id, region_a, region_b, n AS boundary_pixels, u.n_regionkey AS palette_a, w.n_regionkey AS palette_b FROM e JOIN nation u ON u.n_nationkey = region_a JOIN nation w ON w.n_nationkey = region_b")
def edge_palette(spark, sf_dir):
    """Edges with the palette entries of both sides."""
    edges = grid.adjacency(raster(spark, sf_dir, 25), "p", least=0)
    entries = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    for side in "ab":
        small = pal.checked_palette(entries.select(F.col("n_nationkey").alias(f"region_{side}"), F.col("n_regionkey").alias(f"palette_{side}")))
        edges = edges.join(small, f"region_{side}")
    return edges.select("image_id", "region_a", "region_b", "boundary_pixels", "palette_a", "palette_b")


@query(QUERIES, f"WITH {_REGIONS_SQL} SELECT region_id, number, c_mktsegment AS segment FROM regions JOIN customer ON c_custkey = region_id")
def placement_region(spark, sf_dir):
    """Placements with their regions' attributes."""
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("region_id"), F.col("c_mktsegment").alias("segment"))
    return customer_regions(spark, sf_dir).join(who, "region_id").select("region_id", "number", "segment")


# --- sets and reports -----------------------------------------------------------------------------------------------


@query(QUERIES, f"WITH {raster_sql()} SELECT image_id, count(CASE WHEN mask OR v < 64 THEN 1 END) AS union_px, count(CASE WHEN mask AND v < 64 THEN 1 END) AS both_px, count(CASE WHEN mask AND NOT v < 64 THEN 1 END) AS minus_px, count(CASE WHEN mask <> (v < 64) THEN 1 END) AS xor_px FROM raster GROUP BY image_id")
def mask_setops(spark, sf_dir):
    """Union, intersection, difference and symmetric difference of two masks on one table."""
    a, b = F.col("mask"), F.col("v") < 64
    return raster(spark, sf_dir).groupBy("image_id").agg(F.count_if(a | b).alias("union_px"), F.count_if(a & b).alias("both_px"), F.count_if(a & ~b).alias("minus_px"), F.count_if(a != b).alias("xor_px"))


@query(QUERIES, f"WITH {raster_sql()}, e AS (SELECT s.image_id, s.x + 1 AS x0, s.y AS y0, s.x + 1 AS x1, s.y + 1 AS y1 FROM raster s JOIN raster t ON t.image_id = s.image_id AND t.x = s.x + 1 AND t.y = s.y WHERE s.p <> t.p UNION SELECT s.image_id, s.x, s.y + 1, s.x + 1, s.y + 1 FROM raster s JOIN raster t ON t.image_id = s.image_id AND t.x = s.x AND t.y = s.y + 1 WHERE s.p <> t.p) SELECT * FROM e")
def boundary_edges_distinct(spark, sf_dir):
    """Unit boundary edges as corner pairs, each once."""
    p = raster(spark, sf_dir).select(*_XY, "p", F.lead("p").over(grid.row()).alias("r"), F.lead("p").over(grid.column()).alias("b"))
    edge = lambda x0, y0: F.struct(x0.alias("x0"), y0.alias("y0"), (F.col("x") + 1).alias("x1"), (F.col("y") + 1).alias("y1"))
    both = F.array(F.when(F.col("r") != F.col("p"), edge(F.col("x") + 1, F.col("y"))), F.when(F.col("b") != F.col("p"), edge(F.col("x"), F.col("y") + 1)))
    return p.select("image_id", F.explode(F.array_compact(both)).alias("e")).select("image_id", "e.*").dropDuplicates()


@query(QUERIES, f"""WITH {raster_sql()}, {pairs_sql('block')}, e AS (SELECT image_id, least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM pairs WHERE a <> b GROUP BY ALL), s AS (SELECT image_id, count(*) AS edges, sum(n) AS total FROM e GROUP BY image_id),
 r AS (SELECT image_id, block, count(*) AS n FROM raster GROUP BY ALL), q AS (SELECT image_id, count(*) AS regions, min(n) AS min_pixels, max(n) AS max_pixels, median(n) AS median_pixels, count(CASE WHEN n < 25 THEN 1 END) AS below FROM r GROUP BY image_id),
 g AS (SELECT image_id, count(*) AS pixel_count, count(DISTINCT p) AS actual_colors, round(100.0 * sum(mask::INT) / count(*), 6) AS subject_percent, count(CASE WHEN p <> v % 5 THEN 1 END) AS recolored_pixels, round(100.0 * count(CASE WHEN p <> v % 5 THEN 1 END) / count(*), 6) AS recolored_percent FROM raster GROUP BY image_id)
 SELECT image_id, pixel_count, actual_colors, subject_percent, recolored_pixels, recolored_percent, regions, min_pixels, max_pixels, median_pixels, round(min_pixels * 0.0625, 6) AS min_area_mm2, below AS below_count, round(100.0 * below / regions, 6) AS below_percent, regions AS nodes, edges, round(2.0 * edges / regions, 6) AS mean_degree, CAST(total AS BIGINT) AS total_boundary FROM g JOIN q USING (image_id) JOIN s USING (image_id)""")
def stats_report(spark, sf_dir):
    """One report per image, put together from the region, graph, mask and recolouring summaries."""
    pixels = blocks(raster(spark, sf_dir))
    counts = pixels.groupBy("image_id", "p").agg(F.count(F.lit(1)).alias("n"), F.count_if("mask").alias("m"), F.count_if(F.col("p") != F.col("v") % 5).alias("c"))
    whole = counts.groupBy("image_id").agg(F.sum("n").alias("pixel_count"), F.count(F.lit(1)).alias("actual_colors"), F.round(100.0 * F.sum("m") / F.sum("n"), 6).alias("subject_percent"), F.sum("c").alias("recolored_pixels"), F.round(100.0 * F.sum("c") / F.sum("n"), 6).alias("recolored_percent"))
    sizes = pixels.groupBy("image_id", F.col("block").alias("region_id")).agg(F.count(F.lit(1)).alias("pixel_count")).withColumns({"area_mm2": F.col("pixel_count") * 0.0625, "is_below_area_threshold": F.col("pixel_count") < 25})
    graph = regions.graph_summary(sizes.select("image_id", "region_id"), grid.adjacency(pixels, "block"))
    out = whole.join(regions.region_summary(sizes), "image_id").join(graph, "image_id")
    return out.withColumns({c: F.round(c, 6) for c in ("min_area_mm2", "below_percent", "mean_degree")})
