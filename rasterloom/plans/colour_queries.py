"""Colour conversions, differences, masks and palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators import palette as pal
from rasterloom.plans.common import COLOURS, Registry, key_rgb_sql, lab_sql, query, raster, raster_sql, rounded, table

QUERIES: Registry = {}
_R, _G, _B = key_rgb_sql("p_partkey")
_NR, _NG, _NB = key_rgb_sql("n_nationkey")
_COLOURS_SQL = f"colours AS (SELECT n_nationkey AS key, {', '.join(f'{e} AS {n}' for e, n in zip(lab_sql(_NR, _NG, _NB), 'lab'))} FROM nation)"
_PALETTE_SQL = f"{_COLOURS_SQL}, palette AS (SELECT *, CAST(row_number() OVER (ORDER BY l, a, b, key) - 1 AS INTEGER) AS palette_index FROM colours)"


def with_lab(rows: DataFrame, key: str) -> DataFrame:
    r, g, b = color.key_rgb(F.col(key))
    rows = rows.withColumns({"r": r, "g": g, "b": b})
    return rows.withColumns(dict(zip(("l", "a", "lab_b"), color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")), strict=True)))


def nation_colours(spark, sf_dir) -> DataFrame:
    return with_lab(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("n_nationkey").alias("key"), "l", "a", F.col("lab_b").alias("b"))


def palette(spark, sf_dir) -> DataFrame:
    return pal.ranked(nation_colours(spark, sf_dir))


@query(QUERIES, f"SELECT p_partkey, {', '.join(f'round({e}, 6) AS {n}' for e, n in zip(lab_sql(_R, _G, _B), ('l', 'a', 'lab_b')))} FROM part")
def srgb_to_lab(spark, sf_dir):
    return with_lab(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", *rounded("l", "a", "lab_b"))


@query(QUERIES, f"SELECT p_partkey, CAST({_R} AS INTEGER) AS r, CAST({_G} AS INTEGER) AS g, CAST({_B} AS INTEGER) AS b FROM part")
def lab_to_rgb(spark, sf_dir):
    """There and back again: the channels that went in come out."""
    rows = with_lab(table(spark, sf_dir, "part"), "p_partkey")
    r, g, b = color.lab_to_rgb(F.col("l"), F.col("a"), F.col("lab_b"))
    return rows.select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


def _colour_pairs(spark, sf_dir):
    one = nation_colours(spark, sf_dir)
    two = one.select(*[F.col(c).alias(f"{c}2") for c in one.columns])
    return one.join(pal.checked_palette(two), F.col("key") < F.col("key2"))


_PAIRS_SQL = f"WITH {_COLOURS_SQL} SELECT s.key AS key_a, t.key AS key_b, "


@query(QUERIES, _PAIRS_SQL + "round(sqrt(pow(s.l - t.l, 2) + pow(s.a - t.a, 2) + pow(s.b - t.b, 2)), 6) AS delta_e FROM colours s JOIN colours t ON s.key < t.key")
def delta_e76(spark, sf_dir):
    delta = color.delta_e76(tuple(map(F.col, ("l", "a", "b"))), tuple(map(F.col, ("l2", "a2", "b2"))))
    return _colour_pairs(spark, sf_dir).select(F.col("key").alias("key_a"), F.col("key2").alias("key_b"), F.round(delta, 6).alias("delta_e"))


@query(
    QUERIES,
    f"""WITH {_COLOURS_SQL}, c AS (SELECT s.key AS key_a, t.key AS key_b, s.l AS l1, s.a AS a1, s.b AS b1, t.l AS l2, t.a AS a2, t.b AS b2 FROM colours s JOIN colours t ON s.key < t.key),
 d AS (SELECT *, 1 + 0.5 * (1 - sqrt(pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7) / (pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7) + pow(25.0::DOUBLE, 7)))) AS g FROM c),
 e AS (SELECT *, sqrt(a1*g*a1*g+b1*b1) AS c1, sqrt(a2*g*a2*g+b2*b2) AS c2, CASE WHEN degrees(atan2(b1, a1*g)) < 0 THEN degrees(atan2(b1, a1*g)) + 360 ELSE degrees(atan2(b1, a1*g)) END AS h1,
        CASE WHEN degrees(atan2(b2, a2*g)) < 0 THEN degrees(atan2(b2, a2*g)) + 360 ELSE degrees(atan2(b2, a2*g)) END AS h2 FROM d),
 f AS (SELECT *, CASE WHEN h2-h1 > 180 THEN h2-h1-360 WHEN h2-h1 < -180 THEN h2-h1+360 ELSE h2-h1 END AS dh, CASE WHEN abs(h1-h2) <= 180 THEN (h1+h2)/2 WHEN h1+h2 < 360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS h, (l1+l2)/2 AS ml, (c1+c2)/2 AS mc FROM e),
 k AS (SELECT *, 1 - 0.17*cos(radians(h-30)) + 0.24*cos(radians(2*h)) + 0.32*cos(radians(3*h+6)) - 0.20*cos(radians(4*h-63)) AS t, 2*sqrt(c1*c2)*sin(radians(dh/2)) AS dhh FROM f),
 m AS (SELECT *, (l2-l1)/(1+0.015*pow(ml-50,2)/sqrt(20+pow(ml-50,2))) AS tl, (c2-c1)/(1+0.045*mc) AS tc, dhh/(1+0.015*mc*t) AS th, -sin(radians(60*exp(-pow((h-275)/25,2))))*2*sqrt(pow(mc,7)/(pow(mc,7)+pow(25.0::DOUBLE,7))) AS rt FROM k)
 SELECT key_a, key_b, round(sqrt(tl*tl+tc*tc+th*th+rt*tc*th), 6) AS delta_e FROM m""",
)
def delta_e2000(spark, sf_dir):
    delta = color.delta_e2000(tuple(map(F.col, ("l", "a", "b"))), tuple(map(F.col, ("l2", "a2", "b2"))))
    return _colour_pairs(spark, sf_dir).select(F.col("key").alias("key_a"), F.col("key2").alias("key_b"), F.round(delta, 6).alias("delta_e"))


@query(QUERIES, f"SELECT p_partkey, printf('#%02X%02X%02X', {_R}, {_G}, {_B}) AS hex FROM part")
def hex_color(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", color.hex_color(*color.key_rgb(F.col("p_partkey"))).alias("hex"))


@query(QUERIES, f"WITH {raster_sql()} SELECT image_id, x, y, CASE WHEN v = 0 THEN 255 ELSE (v*67+29)%223+24 END AS r, CASE WHEN v = 0 THEN 255 ELSE (v*131+47)%223+24 END AS g, CASE WHEN v = 0 THEN 255 ELSE (v*197+71)%223+24 END AS b FROM raster")
def region_preview_rgb(spark, sf_dir):
    return raster(spark, sf_dir).select("image_id", "x", "y", *[c.alias(n) for c, n in zip(color.preview_rgb(F.col("v")), "rgb", strict=True)])


@query(QUERIES, f"WITH {raster_sql()} SELECT image_id, x, y, CASE WHEN v >= 128 AND mask THEN p + 10 WHEN mask THEN p ELSE p + 5 END AS chosen FROM raster")
def mask_select(spark, sf_dir):
    """Detail inside a mask, subject inside, background outside."""
    chosen = F.when((F.col("v") >= 128) & F.col("mask"), F.col("p") + 10).when(F.col("mask"), F.col("p")).otherwise(F.col("p") + 5)
    return raster(spark, sf_dir).select("image_id", "x", "y", chosen.alias("chosen"))


@query(QUERIES, f"WITH {raster_sql()} SELECT image_id, x, y, CAST(greatest(0, least(255, round_even(CASE WHEN mask THEN v * (1.0::DOUBLE - 0.3::DOUBLE) + ((p * 67 + 29) % 256) * 0.3::DOUBLE ELSE v * (1.0::DOUBLE - 0.32::DOUBLE) + ((p * 67 + 29) % 256) * 0.32::DOUBLE END, 0))) AS INTEGER) AS blended FROM raster")
def mask_blend(spark, sf_dir):
    over = (F.col("p") * 67 + 29) % 256
    return raster(spark, sf_dir).select("image_id", "x", "y", F.when(F.col("mask"), color.blend(F.col("v"), over, 0.3)).otherwise(color.blend(F.col("v"), over, 0.32)).alias("blended"))


@query(QUERIES, f"WITH {raster_sql()} SELECT image_id, count(*) AS pixels, CAST(sum(CASE WHEN v >= 128 THEN 1 ELSE 0 END) AS BIGINT) AS set_pixels, round(100.0 * sum(CASE WHEN v >= 128 THEN 1 ELSE 0 END) / count(*), 6) AS coverage, 100.0 * sum(CASE WHEN v >= 128 THEN 1 ELSE 0 END) / count(*) BETWEEN 0.5 AND 98.5 AS accepted FROM raster GROUP BY image_id")
def mask_coverage(spark, sf_dir):
    """Threshold, coverage in percent and whether it is in the accepted range."""
    share = 100.0 * F.count_if(F.col("v") >= 128) / F.count(F.lit(1))
    return raster(spark, sf_dir).groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("v") >= 128).alias("set_pixels"), F.round(share, 6).alias("coverage"), share.between(0.5, 98.5).alias("accepted"))


@query(QUERIES, f"WITH {_PALETTE_SQL} SELECT key, palette_index, palette_index + 1 AS number FROM palette")
def palette_rank(spark, sf_dir):
    return palette(spark, sf_dir).select("key", "palette_index", (F.col("palette_index") + 1).alias("number"))


@query(QUERIES, f"WITH {_PALETTE_SQL}, {raster_sql(5)}, n AS (SELECT p, count(*) AS n FROM raster GROUP BY p) SELECT palette_index, coalesce(n, 0) AS pixels FROM palette LEFT JOIN n ON p = palette_index")
def palette_histogram(spark, sf_dir):
    return pal.histogram(raster(spark, sf_dir, 5), palette(spark, sf_dir))


@query(QUERIES, f"WITH {_PALETTE_SQL}, {raster_sql(COLOURS)}, n AS (SELECT p, count(*) AS before, count(CASE WHEN v >= 64 THEN 1 END) AS after FROM raster GROUP BY p) SELECT palette_index, palette_index + 1 AS number, printf('#%02X%02X%02X', (key*67+29)%256, (key*131+47)%256, (key*197+71)%256) AS hex, round(l, 4) AS lab_l, round(a, 4) AS lab_a, round(b, 4) AS lab_b, coalesce(before, 0) AS pixels_before, coalesce(after, 0) AS pixels_after FROM palette LEFT JOIN n ON p = palette_index")
def palette_before_after(spark, sf_dir):
    """The palette table with pixel counts before and after a change."""
    counts = raster(spark, sf_dir, COLOURS).groupBy("p").agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("v") >= 64).alias("after"))
    rows = palette(spark, sf_dir).join(counts, F.col("p") == F.col("palette_index"), "left")
    return rows.select("palette_index", (F.col("palette_index") + 1).alias("number"), color.hex_color(*color.key_rgb(F.col("key"))).alias("hex"), *[F.round(c, 4).alias(f"lab_{c}") for c in "lab"], F.coalesce("before", F.lit(0)).alias("pixels_before"), F.coalesce("after", F.lit(0)).alias("pixels_after"))


@query(QUERIES, f"WITH {raster_sql(5)}, n AS (SELECT p, count(*) AS n FROM raster GROUP BY p) SELECT p, n, CAST(row_number() OVER (ORDER BY n DESC, p) AS INTEGER) AS rank FROM n")
def dominance_order(spark, sf_dir):
    counts = raster(spark, sf_dir, 5).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "p")))


@query(QUERIES, f"WITH {_PALETTE_SQL}, {raster_sql(COLOURS)} SELECT image_id, x, y, p, (key*67+29)%256 AS r, (key*131+47)%256 AS g, (key*197+71)%256 AS b FROM raster JOIN palette ON p = palette_index")
def palette_lookup(spark, sf_dir):
    """Every pixel with its palette colour."""
    small = pal.checked_palette(palette(spark, sf_dir).select("palette_index", "key"))
    rows = raster(spark, sf_dir, COLOURS).join(small, F.col("p") == F.col("palette_index"))
    return rows.select("image_id", "x", "y", "p", *[c.alias(n) for c, n in zip(color.key_rgb(F.col("key")), "rgb", strict=True)])


@query(QUERIES, f"WITH {_PALETTE_SQL}, parts AS (SELECT p_partkey, {', '.join(f'{e} AS {n}' for e, n in zip(lab_sql(_R, _G, _B), ('pl', 'pa', 'pb')))} FROM part), d AS (SELECT p_partkey, palette_index, pow(pl - l, 2) + pow(pa - a, 2) + pow(pb - b, 2) AS d FROM parts CROSS JOIN palette) SELECT p_partkey, CAST(arg_min(palette_index, d) AS INTEGER) AS palette_index, round(min(d), 4) AS distance FROM d GROUP BY p_partkey")
def quantize_assign(spark, sf_dir):
    """Each colour's nearest palette entry."""
    points = with_lab(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "l", "a", F.col("lab_b").alias("b"))
    return pal.nearest(points, palette(spark, sf_dir), ("l", "a", "b"), ("p_partkey",)).withColumn("distance", F.round("distance", 4))


@query(QUERIES, f"WITH {_PALETTE_SQL} SELECT s.palette_index AS left_index, t.palette_index AS right_index, round(sqrt(pow(s.l - t.l, 2) + pow(s.a - t.a, 2) + pow(s.b - t.b, 2)), 6) AS delta FROM palette s JOIN palette t ON s.palette_index < t.palette_index")
def palette_pairs(spark, sf_dir):
    one = palette(spark, sf_dir)
    two = one.select(*[F.col(c).alias(f"{c}2") for c in one.columns])
    delta = color.delta_e76(tuple(map(F.col, ("l", "a", "b"))), tuple(map(F.col, ("l2", "a2", "b2"))))
    return one.join(pal.checked_palette(two), F.col("palette_index") < F.col("palette_index2")).select(F.col("palette_index").alias("left_index"), F.col("palette_index2").alias("right_index"), F.round(delta, 6).alias("delta"))


@query(QUERIES, f"WITH {_COLOURS_SQL}, {raster_sql(COLOURS)}, n AS (SELECT p, greatest(1, count(*)) AS w FROM raster GROUP BY p), j AS (SELECT key % 3 AS grp, l, a, b, coalesce(w, 1) AS w FROM colours LEFT JOIN n ON p = key) SELECT grp, round(sum(l * w) / sum(w), 6) AS l, round(sum(a * w) / sum(w), 6) AS a, round(sum(b * w) / sum(w), 6) AS b FROM j GROUP BY grp")
def weighted_centre(spark, sf_dir):
    """Count-weighted mean colour of groups of palette entries."""
    counts = raster(spark, sf_dir, COLOURS).groupBy("p").agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"))
    rows = nation_colours(spark, sf_dir).join(counts, F.col("p") == F.col("key"), "left").withColumn("w", F.coalesce("n", F.lit(1)))
    return rows.groupBy((F.col("key") % 3).alias("grp")).agg(*[F.round(F.sum(F.col(c) * F.col("w")) / F.sum("w"), 6).alias(c) for c in "lab"])


@query(QUERIES, f"SELECT count(DISTINCT ({', '.join(f'round({e}, 4)' for e in lab_sql(_R, _G, _B))})) AS colours FROM part")
def distinct_colours(spark, sf_dir):
    rows = with_lab(table(spark, sf_dir, "part"), "p_partkey")
    return rows.select(*[F.round(c, 4).alias(c) for c in ("l", "a", "lab_b")]).distinct().agg(F.count(F.lit(1)).alias("colours"))


@query(QUERIES, "WITH n AS (SELECT n_nationkey AS key, n_regionkey < 2 AS subject, row_number() OVER (PARTITION BY n_regionkey < 2 ORDER BY n_nationkey) - 1 AS place FROM nation) SELECT CAST(CASE WHEN subject THEN place ELSE place + (SELECT count(*) FROM n WHERE subject) END AS INTEGER) AS palette_index, key FROM n")
def palette_union(spark, sf_dir):
    """Subject and background palettes in one, the background's indices behind."""
    place = (F.row_number().over(Window.partitionBy(F.col("n_regionkey") < 2).orderBy("n_nationkey")) - 1).cast("int")
    n = table(spark, sf_dir, "nation").select(place.alias("palette_index"), F.col("n_nationkey").alias("key"), (F.col("n_regionkey") < 2).alias("subject"))
    subject, background = n.where("subject"), n.where("not subject")
    return pal.joined_palettes(subject, background)


@query(QUERIES, f"WITH {_PALETTE_SQL} SELECT to_json({{'number': palette_index + 1, 'hex': printf('#%02X%02X%02X', (key*67+29)%256, (key*131+47)%256, (key*197+71)%256), 'rgb': [(key*67+29)%256, (key*131+47)%256, (key*197+71)%256]}}) ::VARCHAR AS payload FROM palette")
def palette_payload(spark, sf_dir):
    """The palette as response JSON."""
    rgb = color.key_rgb(F.col("key"))
    return palette(spark, sf_dir).select(F.to_json(F.struct((F.col("palette_index") + 1).alias("number"), color.hex_color(*rgb).alias("hex"), F.array(*rgb).alias("rgb"))).alias("payload"))
