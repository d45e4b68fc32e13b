"""Polylines: areas, smoothing, paths, tracing and vector zones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rasterloom.functions import polyline
from rasterloom.operators import kernels, tiles, tracing
from rasterloom.operators.regions import to_dense
from rasterloom.plans.common import Registry, query, raster, raster_sql, table
from rasterloom.session import materialize

QUERIES: Registry = {}
TILE = 32
_POINTS_SQL = "pts AS (SELECT vec_id, [{'x': round(embedding[2*i+1]::DOUBLE, 4), 'y': round(embedding[2*i+2]::DOUBLE, 4)} for i in range(0, 8)] AS p FROM embeddings)"
_NEXT = "CASE WHEN i = len(p) THEN p[1] ELSE p[i+1] END"


def points(spark, sf_dir):
    pairs = [F.struct(F.round(F.col("embedding")[2 * i].cast("double"), 4).alias("x"), F.round(F.col("embedding")[2 * i + 1].cast("double"), 4).alias("y")) for i in range(8)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(*pairs).alias("p"))


def _digest(column: str) -> list:
    """Number of points and weighted sums that depend on their order."""
    sums = lambda axis: F.aggregate(F.transform(F.col(column), lambda q, i: q[axis] * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return [F.size(column).alias("n"), F.round(sums("x"), 6).alias("sx"), F.round(sums("y"), 6).alias("sy")]


def _digest_sql(column: str) -> str:
    return f"len({column}) AS n, round(list_sum([{column}[i].x * i for i in range(1, len({column}) + 1)]), 6) AS sx, round(list_sum([{column}[i].y * i for i in range(1, len({column}) + 1)]), 6) AS sy"


@query(QUERIES, f"WITH {_POINTS_SQL} SELECT vec_id, round(abs(list_sum([p[i].x * ({_NEXT}).y - ({_NEXT}).x * p[i].y for i in range(1, 9)])) / 2, 6) AS area FROM pts")
def shoelace_area(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", F.round(polyline.shoelace_area(F.col("p")), 6).alias("area"))


_CUT = "flatten([[{{'x': p[i].x * 0.75 + ({n}).x * 0.25, 'y': p[i].y * 0.75 + ({n}).y * 0.25}}, {{'x': p[i].x * 0.25 + ({n}).x * 0.75, 'y': p[i].y * 0.25 + ({n}).y * 0.75}}] for i in range(1, {end})])"


@query(QUERIES, f"WITH {_POINTS_SQL}, a AS (SELECT vec_id, {_CUT.format(n=_NEXT, end='len(p) + 1')} AS p FROM pts), b AS (SELECT vec_id, {_CUT.format(n=_NEXT, end='len(p) + 1')} AS p FROM a) SELECT vec_id, {_digest_sql('p')} FROM b")
def chaikin_closed(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", polyline.chaikin(F.col("p"), 2).alias("s")).select("vec_id", *_digest("s"))


def _open(source: str) -> str:
    return f"SELECT vec_id, list_concat([p[1]], {_CUT.format(n='p[i+1]', end='len(p)')}, [p[len(p)]]) AS p FROM {source}"


@query(QUERIES, f"WITH {_POINTS_SQL}, a AS ({_open('pts')}), b AS ({_open('a')}) SELECT vec_id, {_digest_sql('p')} FROM b")
def chaikin_open(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", polyline.chaikin(F.col("p"), 2, closed=False).alias("s")).select("vec_id", *_digest("s"))


_NUM = "CASE WHEN abs(v - round_even(v, 0)) < 1e-9 THEN CAST(CAST(round_even(v, 0) AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.3f', v), '0+$', ''), '[.]$', '') END"


@query(QUERIES, f"WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) ELSE event_id * 0.125::DOUBLE + 0.0625::DOUBLE * (event_id % 2) * 0 END AS v FROM events) SELECT event_id, {_NUM} AS formatted FROM v")
def format_number(spark, sf_dir):
    v = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("double")).otherwise(F.col("event_id") * 0.125)
    return table(spark, sf_dir, "events").select("event_id", polyline.format_number(v).alias("formatted"))


@query(QUERIES, "WITH p AS (SELECT conv_id, turn, [CAST(conv_id % 50 AS DOUBLE), CAST(turn AS DOUBLE), conv_id % 50 + 0.5::DOUBLE, turn + 0.25::DOUBLE] AS c FROM conversations) SELECT conv_id, turn, 'M ' || CAST(c[1] AS BIGINT) || ' ' || CAST(c[2] AS BIGINT) || ' L ' || CAST(conv_id % 50 AS BIGINT) || '.5 ' || CAST(turn AS BIGINT) || '.25 Z' AS path FROM p")
def svg_path(spark, sf_dir):
    x, y = (F.col("conv_id") % 50).cast("double"), F.col("turn").cast("double")
    line = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 0.5).alias("x"), (y + 0.25).alias("y")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", polyline.svg_path(line, True).alias("path"))


@query(QUERIES, f"WITH {_POINTS_SQL}, m AS (SELECT vec_id, [{{'x': 12 + q.x * 0.25, 'y': 20 + q.y * 0.25}} for q in p] AS p FROM pts) SELECT vec_id, {_digest_sql('p')} FROM m")
def page_transform(spark, sf_dir):
    moved = polyline.to_page(F.col("p"), F.lit(12.0), F.lit(20.0), F.lit(0.25))
    return points(spark, sf_dir).select("vec_id", moved.alias("s")).select("vec_id", *_digest("s"))


_SVG_SQL = """WITH c AS (SELECT c_nationkey, c_custkey, printf('<path d="M %d 0 L %d 9" fill="none" stroke="#222" stroke-width="0.25"/>', c_custkey, c_custkey) AS p, printf('<text x="%d.000" y="4.500" font-size="3.200" text-anchor="middle" dominant-baseline="central">%d</text>', c_custkey, c_custkey % 25 + 1) AS t FROM customer)
SELECT c_nationkey, '<svg xmlns="http://www.w3.org/2000/svg" width="210mm" height="297mm" viewBox="0 0 210 297">' || chr(10) || '<title>' || c_nationkey || ' &amp; more</title>' || chr(10) || string_agg(p, chr(10) ORDER BY c_custkey) || chr(10) || string_agg(t, chr(10) ORDER BY c_custkey) || chr(10) || '</svg>' AS document FROM c GROUP BY c_nationkey"""


@query(QUERIES, _SVG_SQL)
def svg_document(spark, sf_dir):
    """Each nation's customers as lines and numbers of one sheet, written by the sheets' own writer."""
    from rasterloom.sources.sinks import svg_sheet

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(group["c_custkey"].tolist())
        text = svg_sheet(210, 297, f"{group['c_nationkey'].iloc[0]} & more", [(f"M {i} 0 L {i} 9", "#222", 0.25) for i in keys], [(i, 4.5, 3.2, str(i % 25 + 1)) for i in keys])
        return pd.DataFrame({"c_nationkey": [group["c_nationkey"].iloc[0]], "document": [text]})

    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").groupBy("c_nationkey").applyInPandas(run, "c_nationkey int, document string")


#: Zones as discs and polylines: each embedding's first three points, scaled to the 100 x 100 page.
_ZONE_SQL = "zones AS (SELECT vec_id, CAST(vec_id // 64 AS INTEGER) AS page, vec_id % 2 AS kind, 50 + 200 * embedding[1]::DOUBLE AS ax, 50 + 200 * embedding[2]::DOUBLE AS ay, 50 + 200 * embedding[3]::DOUBLE AS bx, 50 + 200 * embedding[4]::DOUBLE AS by_ FROM embeddings)"

ZONES_A_PAGE = 64


def _zones(embeddings):
    e = lambda i: 50 + 200 * F.col("embedding")[i].cast("double")
    line = F.array(F.struct(e(0).alias("x"), e(1).alias("y")), F.struct(e(2).alias("x"), e(3).alias("y")))
    return embeddings.select(F.floor(F.col("vec_id") / ZONES_A_PAGE).cast("int").alias("page"), F.when(F.col("vec_id") % 2 == 0, F.slice(line, 1, 1)).otherwise(line).alias("points"), F.lit(4.0).alias("radius"))


@query(QUERIES, f"""WITH {_ZONE_SQL}, box AS (SELECT *, CAST(floor(least(ax, CASE WHEN kind = 0 THEN ax ELSE bx END) - 5) AS INTEGER) AS x0, CAST(ceil(greatest(ax, CASE WHEN kind = 0 THEN ax ELSE bx END) + 5) AS INTEGER) AS x1,
  CAST(floor(least(ay, CASE WHEN kind = 0 THEN ay ELSE by_ END) - 5) AS INTEGER) AS y0, CAST(ceil(greatest(ay, CASE WHEN kind = 0 THEN ay ELSE by_ END) + 5) AS INTEGER) AS y1 FROM zones),
 wide AS (SELECT *, unnest(range(greatest(0, x0), least(99, x1) + 1)) AS x FROM box), cells AS (SELECT *, unnest(range(greatest(0, y0), least(99, y1) + 1)) AS y FROM wide),
 d AS (SELECT *, CASE WHEN kind = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((x + 0.5 - ax) * (bx - ax) + (y + 0.5 - ay) * (by_ - ay)) / greatest(1e-9, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) END AS t FROM cells)
 SELECT DISTINCT page, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM d WHERE pow(x + 0.5 - ax - t * (bx - ax), 2) + pow(y + 0.5 - ay - t * (by_ - ay), 2) <= 16""")
def zone_raster(spark, sf_dir):
    """The pixels within four of every embedding's point or line, ``ZONES_A_PAGE`` zones to a page; each zone makes only the pixels of its own box."""
    from rasterloom.sources.zones import rasterize

    return rasterize(_zones(table(spark, sf_dir, "embeddings")), 100, 100, ("page",))


def _per_image(pixels, run, schema):
    return pixels.groupBy("image_id").applyInPandas(run, schema)


@query(QUERIES)
def boundary_polylines(spark, sf_dir):
    """Traced boundaries of every image: number of points and the ends of each line."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        labels, _ = to_dense(group, "p")
        lines = kernels.trace(kernels.boundary_edges(labels))
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "path_id": range(len(lines)), "n": [len(q) for q in lines], "closed": [q[0] == q[-1] for q in lines], "points": [[{"x": x, "y": y} for x, y in kernels.simplify(q, 0.4)] for q in lines]})

    return _per_image(raster(spark, sf_dir, 2), run, "image_id int, path_id long, n long, closed boolean, points array<struct<x: double, y: double>>")


@query(QUERIES)
def mask_contours(spark, sf_dir):
    """Closed contours of every image's mask."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        mask, _ = to_dense(group, "mask")
        loops = kernels.mask_contours(mask)
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "loop_id": range(len(loops)), "points": [[{"x": x, "y": y} for x, y in q] for q in loops]})

    return _per_image(raster(spark, sf_dir), run, "image_id int, loop_id long, points array<struct<x: double, y: double>>")


@query(QUERIES)
def contour_nesting(spark, sf_dir):
    """Every contour's closest surrounding one and depth; those at odd depth are holes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        mask, _ = to_dense(group, "mask")
        loops = kernels.mask_contours(mask)
        parents, depths = zip(*kernels.nest_rings(loops)) if loops else ((), ())
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "loop_id": range(len(loops)), "parent": parents, "depth": depths, "hole": [d % 2 == 1 for d in depths], "area": [abs(kernels.ring_area(q)) for q in loops]})

    return _per_image(raster(spark, sf_dir), run, "image_id int, loop_id long, parent long, depth long, hole boolean, area double")


def _gray_pixels(spark, sf_dir):
    return raster(spark, sf_dir).withColumn("v", F.col("v") / 255.0)


@query(QUERIES)
def bilateral_filter(spark, sf_dir):
    """Two rounds of edge-preserving smoothing over tiles with margins."""
    return tiles.bilateral(_gray_pixels(spark, sf_dir), ["v"], [(0.055, 3.0), (0.08, 4.95)], TILE).withColumnRenamed("soft_v", "soft")


@query(QUERIES)
def canny_edges(spark, sf_dir):
    """Fine and coarse edges."""
    gray = _gray_pixels(spark, sf_dir)
    fine, coarse = tiles.canny(gray, "v", 1.05, 0.045, 0.16, TILE, "fine"), tiles.canny(gray, "v", 2.15, 0.035, 0.13, TILE, "coarse")
    return fine.join(coarse, ["image_id", "x", "y"])


@query(QUERIES)
def line_art(spark, sf_dir):
    """Thinned inner strokes away from region boundaries."""
    return tiles.line_art(_gray_pixels(spark, sf_dir).withColumn("b", F.floor(F.col("x") / 25).cast("int")), "v", "mask", "b", TILE)


@query(QUERIES)
def skeleton_paths(spark, sf_dir):
    """Strokes of the thinned mask as polylines."""
    thin = tiles.thinned(raster(spark, sf_dir), "mask", "thin", TILE)
    return tracing.skeleton_lines(materialize(thin, "thin"), "thin")


#: Chains from each end or junction by recursion over their way on; rings from their smallest node to its smaller neighbour.
_TRACES_SQL = f"""WITH RECURSIVE {raster_sql(2)}, box AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM raster GROUP BY image_id),
 cells AS (SELECT r.image_id, r.x, r.y, r.p, mx, my, l.p AS lp, u.p AS up FROM raster r JOIN box USING (image_id) LEFT JOIN raster l ON l.image_id = r.image_id AND l.x = r.x - 1 AND l.y = r.y LEFT JOIN raster u ON u.image_id = r.image_id AND u.x = r.x AND u.y = r.y - 1),
 edges AS MATERIALIZED (SELECT image_id, x * 1000 + y AS a, x * 1000 + y + 1 AS b FROM cells WHERE lp IS DISTINCT FROM p UNION ALL SELECT image_id, (x + 1) * 1000 + y, (x + 1) * 1000 + y + 1 FROM cells WHERE x = mx
  UNION ALL SELECT image_id, x * 1000 + y, (x + 1) * 1000 + y FROM cells WHERE up IS DISTINCT FROM p UNION ALL SELECT image_id, x * 1000 + y + 1, (x + 1) * 1000 + y + 1 FROM cells WHERE y = my),
 darts AS MATERIALIZED (SELECT image_id, a, b FROM edges UNION ALL SELECT image_id, b, a FROM edges),
 nodes AS MATERIALIZED (SELECT image_id, a AS node, count(*) AS degree, min(b) AS low, max(b) AS high FROM darts GROUP BY ALL),
 walk(image_id, ring, start, second, before, here, pos) AS (
  SELECT d.image_id, n.degree = 2, d.a, d.b, d.a, d.b, 1 FROM darts d JOIN nodes n ON n.image_id = d.image_id AND n.node = d.a WHERE n.degree <> 2 OR (d.b = n.low AND d.b > d.a)
  UNION ALL SELECT w.image_id, ring, start, second, here, CASE WHEN before = low THEN high ELSE low END, pos + 1 FROM walk w JOIN nodes n ON n.image_id = w.image_id AND n.node = w.here WHERE n.degree = 2 AND w.here <> w.start AND (NOT ring OR w.here > w.start)),
 ended AS (SELECT w.* FROM walk w JOIN nodes n ON n.image_id = w.image_id AND n.node = w.here WHERE CASE WHEN ring THEN w.here = w.start ELSE n.degree <> 2 END),
 kept AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ring, start, second) - 1 AS path_id FROM ended WHERE ring OR start < here OR (start = here AND second <= before)),
 spots AS (SELECT k.image_id, k.path_id, w.pos, w.here AS node FROM kept k JOIN walk w ON w.image_id = k.image_id AND w.start = k.start AND w.second = k.second AND w.ring = k.ring AND w.pos <= k.pos UNION ALL SELECT image_id, path_id, 0, start FROM kept)
 SELECT image_id, path_id, count(*) AS n, arg_min(node, pos) = arg_max(node, pos) AS closed, CAST(sum(pos * (node // 1000)) AS BIGINT) AS sx, CAST(sum(pos * (node % 1000)) AS BIGINT) AS sy FROM spots GROUP BY image_id, path_id"""


@query(QUERIES, _TRACES_SQL)
def boundary_traces(spark, sf_dir):
    """Boundary lines by list ranking: points, whether closed, and sums that depend on the points' order."""
    traced = tracing.trace(tracing.boundary_edges(raster(spark, sf_dir, 2), "p"))
    ends = F.min_by("node", "position") == F.max_by("node", "position")
    weighted = lambda c: F.sum(F.col("position") * c)
    return traced.groupBy("image_id", "path_id").agg(F.count(F.lit(1)).alias("n"), ends.alias("closed"), weighted(tracing.first_of("node")).alias("sx"), weighted(tracing.second_of("node")).alias("sy"))
