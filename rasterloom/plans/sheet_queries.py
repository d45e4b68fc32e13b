"""Sheet geometry, adaptive parameters, label sizes, request parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import sheet
from rasterloom.operators import regions
from rasterloom.plans.config import violations
from rasterloom.plans.common import Registry, query, rounded, table
from rasterloom.session import scratch_path
from rasterloom.sources import inserts, sinks
from rasterloom.sources.images import decode_data_url

QUERIES: Registry = {}

#: Parts as images: width and height from the key, format and orientation from size.
_IMAGES_SQL = """images AS (SELECT p_partkey, CAST(p_partkey * 37 % 1900 + 64 AS INTEGER) AS w, CAST(p_partkey * 53 % 1300 + 64 AS INTEGER) AS h,
  CASE WHEN p_size % 2 = 0 THEN 'a3' ELSE 'a4' END AS page_format, CASE WHEN p_size % 3 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation, CAST(p_size % 15 AS DOUBLE) AS margin, 4.0::DOUBLE + p_size % 12 AS area, p_size % 30 + 2 AS colors FROM part)"""
_PAGE_SQL = """page AS (SELECT *, CASE WHEN orientation = 'landscape' THEN long ELSE short END AS pw, CASE WHEN orientation = 'landscape' THEN short ELSE long END AS ph
  FROM (SELECT *, CASE WHEN page_format = 'a4' THEN 210.0::DOUBLE ELSE 297.0::DOUBLE END AS short, CASE WHEN page_format = 'a4' THEN 297.0::DOUBLE ELSE 420.0::DOUBLE END AS long FROM images))"""


def images(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") * 37 % 1900 + 64).cast("int").alias("w"), (F.col("p_partkey") * 53 % 1300 + 64).cast("int").alias("h"),
        F.when(size % 2 == 0, "a3").otherwise("a4").alias("page_format"), F.when(size % 3 == 0, "landscape").otherwise("portrait").alias("orientation"),
        (size % 15).cast("double").alias("margin"), (4.0 + size % 12).alias("area"), (size % 30 + 2).alias("colors"),
    )


@query(QUERIES, f"""WITH {_IMAGES_SQL}, {_PAGE_SQL}, s AS (SELECT *, pw - 2 * margin AS rw, ph - 2 * margin AS rh, ph - 2 * margin - 20 AS bh, least((pw - 2 * margin) / w, (ph - 2 * margin - 20) / h) AS s FROM page)
 SELECT p_partkey, round(pw, 6) AS page_width_mm, round(ph, 6) AS page_height_mm, round(rw, 6) AS printable_width_mm, round(rh, 6) AS printable_height_mm, round(w * s, 6) AS image_width_mm, round(h * s, 6) AS image_height_mm,
 round(margin + (rw - w * s) / 2, 6) AS image_origin_x_mm, round(margin + (bh - h * s) / 2, 6) AS image_origin_y_mm, round(margin + bh, 6) AS legend_origin_y_mm, round(s, 6) AS mm_per_pixel, round(s * s, 6) AS pixel_area_mm2,
 CAST(greatest(1, ceil(area / (s * s))) AS INTEGER) AS min_region_pixels FROM s""")
def print_geometry(spark, sf_dir):
    out = sheet.print_geometry(F.col("w"), F.col("h"), F.col("page_format"), F.col("orientation"), F.col("margin"), F.col("area"), F.lit(20.0))
    return images(spark, sf_dir).select("p_partkey", *[c.alias(n) if n == "min_region_pixels" else F.round(c, 6).alias(n) for n, c in out.items()])


@query(QUERIES, f"WITH {_IMAGES_SQL}, {_PAGE_SQL} SELECT p_partkey, 9.0::DOUBLE + 7.0::DOUBLE * ceil(colors / greatest(1, floor((pw - 2 * margin) / 30))) AS legend_mm FROM page")
def legend_height(spark, sf_dir):
    return images(spark, sf_dir).select("p_partkey", sheet.legend_height(F.col("page_format"), F.col("orientation"), F.col("margin"), F.col("colors")).alias("legend_mm"))


@query(QUERIES, f"""WITH {_IMAGES_SQL}, k AS (SELECT *, CASE WHEN greatest(w, h) >= 1400 OR w * h >= 1400000 THEN 'large' WHEN greatest(w, h) <= 900 OR w * h <= 600000 THEN 'small' ELSE 'medium' END AS size_class FROM images)
 SELECT p_partkey, size_class, CAST(greatest(10, least(20000, round_even((300 + colors * 50) * CASE size_class WHEN 'large' THEN 1.22::DOUBLE WHEN 'small' THEN 0.72::DOUBLE ELSE 1.0 END, 0))) AS INTEGER) AS tuned_superpixels,
 round(greatest(1.0, least(80.0, area * CASE size_class WHEN 'large' THEN 0.90::DOUBLE WHEN 'small' THEN 1.35::DOUBLE ELSE 1.0 END)), 6) AS tuned_area_mm2,
 round(greatest(1.0, least(80.0, 6.0 * CASE size_class WHEN 'large' THEN 0.90::DOUBLE WHEN 'small' THEN 1.15::DOUBLE ELSE 1.0 END)), 6) AS tuned_subject_mm2,
 round(greatest(1.0, least(120.0, 28.0 * CASE size_class WHEN 'large' THEN 0.95::DOUBLE WHEN 'small' THEN 1.20::DOUBLE ELSE 1.0 END)), 6) AS tuned_background_mm2,
 round(greatest(0.75, least(40.0, 4.0 * CASE size_class WHEN 'large' THEN 0.75::DOUBLE ELSE 1.0 END)), 6) AS tuned_detail_mm2,
 CAST(greatest(colors % 3, CASE size_class WHEN 'small' THEN 2 ELSE 1 END) AS INTEGER) AS tuned_smoothing FROM k""")
def size_class(spark, sf_dir):
    rows = images(spark, sf_dir).withColumn("size_class", sheet.size_class(F.col("w"), F.col("h")))
    out = sheet.auto_tune(F.col("size_class"), 300 + F.col("colors") * 50, F.col("area"), F.lit(6.0), F.lit(28.0), F.lit(4.0), F.col("colors") % 3)
    return rows.select("p_partkey", "size_class", *[F.round(c, 6).alias(n) if n.endswith("mm2") else c.alias(n) for n, c in out.items()])


@query(QUERIES, f"WITH {_IMAGES_SQL} SELECT p_partkey, CAST(greatest(256, least(2400, CASE WHEN greatest(w, h) * 2 <= 900 THEN 900 WHEN greatest(w, h) * 2 >= 2400 THEN 1600 ELSE 1200 END)) AS INTEGER) AS max_side FROM images")
def auto_max_side(spark, sf_dir):
    return images(spark, sf_dir).select("p_partkey", sheet.auto_max_side(F.greatest("w", "h") * 2).alias("max_side"))


_REGIONS_SQL = "regions AS (SELECT c_nationkey AS image_id, c_custkey AS region_id, count(*) AS pixel_count, sum(o_totalprice) / 10000 AS area_mm2, CAST(c_custkey % 25 + 1 AS INTEGER) AS number FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"


def customer_regions(spark, sf_dir):
    """Customers as regions: orders are their pixels, prices their area. Orders are summed before the join."""
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("region_id")).agg(F.count(F.lit(1)).alias("pixel_count"), (F.sum("o_totalprice") / 10000).alias("area_mm2"))
    who = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image_id"), F.col("c_custkey").alias("region_id"), (F.col("c_custkey") % 25 + 1).cast("int").alias("number"))
    return who.join(sums, "region_id")


_FONT_SQL = "(1.8 + 1.4 * greatest(0.0, least(1.0, CASE WHEN area_mm2 / 9.0 > 1 THEN (sqrt(area_mm2 / 9.0) - 1) / (sqrt(12.0::DOUBLE) - 1) ELSE 0 END)))"


@query(QUERIES, f"WITH {_REGIONS_SQL} SELECT region_id, round({_FONT_SQL}, 6) AS font_mm FROM regions")
def font_scale(spark, sf_dir):
    font = sheet.scaled_font(F.col("area_mm2"), F.lit(9.0), F.lit(0.04), F.lit(3.2), F.lit(1.8))
    return customer_regions(spark, sf_dir).select("region_id", F.round(font, 6).alias("font_mm"))


_FIT_SQL = f"""WITH {_REGIONS_SQL}, f AS (SELECT *, {_FONT_SQL} AS target, greatest(0.1, (sqrt(pixel_count) - 0.5) * 0.2) AS clearance FROM regions),
 g AS (SELECT *, least(target, greatest(0.03, 2 * clearance - 2 * least(0.45, 0.24 * clearance)) / greatest(1.0, 0.62 * length(number::VARCHAR))) AS font FROM f)"""


def fitted_labels(spark, sf_dir):
    rows = customer_regions(spark, sf_dir).withColumn("target", sheet.scaled_font(F.col("area_mm2"), F.lit(9.0), F.lit(0.04), F.lit(3.2), F.lit(1.8)))
    return rows.withColumns(sheet.fitted_font(F.col("number"), F.sqrt("pixel_count"), F.lit(0.2), F.col("target"), F.lit(0.45), F.lit(1.8)))


@query(QUERIES, _FIT_SQL + " SELECT region_id, number, round(clearance, 6) AS clearance_mm, round(font, 6) AS font_size_mm, CASE WHEN font + 1e-9 < 1.8 THEN 'police_reduite_sous_seuil' ELSE '' END AS reason FROM g")
def font_fit(spark, sf_dir):
    return fitted_labels(spark, sf_dir).select("region_id", "number", *rounded("clearance_mm", "font_size_mm"), "reason")


_PLACED_SQL = _FIT_SQL + """, l AS (SELECT c_nationkey AS image_id, c_custkey AS region_id, CAST(c_custkey % 25 + 1 AS INTEGER) AS number, font, font IS NOT NULL AS placed FROM customer LEFT JOIN g ON g.region_id = c_custkey),
 a AS (SELECT image_id, count(*) AS region_count, count(DISTINCT number) AS actual_colors, count(CASE WHEN placed THEN 1 END) AS placed_count, count(CASE WHEN NOT placed THEN 1 END) AS skipped_count, 100.0::DOUBLE * count(CASE WHEN placed THEN 1 END) / count(*) AS coverage_percent,
  count(CASE WHEN placed AND font + 1e-9 < 1.8 THEN 1 END) AS reduced_font_count, coalesce(min(font), 0.0) AS smallest_font_mm, coalesce(list_sort(list(region_id) FILTER (WHERE NOT placed)), []) AS skipped_region_ids FROM l GROUP BY image_id)"""


def placements(spark, sf_dir):
    """A label for every customer; those without orders have no pixel that could hold one and are skipped."""
    who = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image_id"), F.col("c_custkey").alias("region_id"), (F.col("c_custkey") % 25 + 1).cast("int").alias("number"))
    made = fitted_labels(spark, sf_dir).select("region_id", "font_size_mm", "reason")
    return who.join(made, "region_id", "left").withColumn("status", F.when(F.col("font_size_mm").isNull(), "skipped").otherwise("placed"))


@query(QUERIES, _PLACED_SQL + " SELECT image_id, region_count, placed_count, skipped_count, round(coverage_percent, 6) AS coverage_percent, reduced_font_count, round(smallest_font_mm, 6) AS smallest_font_mm, skipped_region_ids FROM a")
def labelling_summary(spark, sf_dir):
    """Placed and skipped labels of every image, with the ids of the skipped ones."""
    out = regions.labelling_summary(placements(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("coverage_percent", "smallest_font_mm")})


@query(QUERIES, _PLACED_SQL + """ SELECT image_id, list_filter([CASE WHEN skipped_count <> 0 THEN 'skipped' END, CASE WHEN coverage_percent <> 100.0 THEN 'coverage' END, CASE WHEN actual_colors < 2 THEN 'colors' END, CASE WHEN placed_count < 1 THEN 'regions' END], lambda x: x IS NOT NULL) AS violations FROM a
 WHERE skipped_count <> 0 OR coverage_percent <> 100.0 OR actual_colors < 2 OR placed_count < 1""")
def benchmark_gate(spark, sf_dir):
    """Images that miss the quality gate, with the limits that they miss."""
    rows = placements(spark, sf_dir)
    colours = rows.groupBy("image_id").agg(F.countDistinct("number").alias("actual_colors"))
    metrics = regions.labelling_summary(rows).join(colours, "image_id").withColumn("regions_after", F.col("placed_count"))
    return regions.gate_violations(metrics).select("image_id", "violations")


@query(QUERIES, f"""WITH {_IMAGES_SQL} SELECT p_partkey, round(greatest(0.18, least(0.42, 0.25 * CASE WHEN page_format = 'a3' THEN 1.12::DOUBLE ELSE 1.0 END + greatest(0.0, least(0.06, (200.0 / w - 0.16) * 0.45)))), 6) AS line_width_mm,
 CAST(CASE WHEN 200.0::DOUBLE / w >= 0.22 THEN least(3, greatest(2, colors % 4 + 1)) ELSE greatest(1, colors % 4) END AS INTEGER) AS smoothing_iterations,
 round(greatest(18.0, greatest(2.5, least(8.0, area * 0.4)) / pow(200.0::DOUBLE / w, 2)), 8) AS min_smooth_area_px, round(0.1 / (200.0::DOUBLE / w), 8) AS simplify_tolerance_px FROM images""")
def render_profile(spark, sf_dir):
    out = sheet.render_profile(F.col("page_format"), F.lit(200.0) / F.col("w"), F.lit(0.25), F.col("colors") % 4, F.col("area"), F.lit(18.0), F.lit(0.1))
    return images(spark, sf_dir).select("p_partkey", *[c.alias(n) if n == "smoothing_iterations" else F.round(c, 8 if n.endswith("px") else 6).alias(n) for n, c in out.items()])


@query(QUERIES, "SELECT n_nationkey, 12.0::DOUBLE + (n_nationkey % 6) * 30.0::DOUBLE AS x_mm, 250.0::DOUBLE + (n_nationkey // 6) * 7.0::DOUBLE AS y_mm FROM nation")
def palette_layout(spark, sf_dir):
    x, y = sheet.palette_cell(F.col("n_nationkey"), 6, 12.0, 250.0, 30.0, 7.0)
    return table(spark, sf_dir, "nation").select("n_nationkey", x.alias("x_mm"), y.alias("y_mm"))


_RAW_SQL = "raw AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'x' || event_id WHEN 1 THEN NULL WHEN 2 THEN CAST(event_id % 90 AS VARCHAR) WHEN 3 THEN ' Off ' ELSE CAST(-event_id AS VARCHAR) END AS raw FROM events)"


def raw_values(spark, sf_dir):
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, F.concat(F.lit("x"), e)).when(e % 5 == 1, None).when(e % 5 == 2, (e % 90).cast("string")).when(e % 5 == 3, " Off ").otherwise((-e).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@query(QUERIES, f"WITH {_RAW_SQL} SELECT event_id, coalesce(greatest(2, least(40, TRY_CAST(raw AS INTEGER))), 24) AS colors, coalesce(greatest(0.0::DOUBLE, least(12.0::DOUBLE, TRY_CAST(raw AS DOUBLE))), 4.0::DOUBLE) AS delta_e, CASE WHEN raw IS NULL THEN true ELSE lower(trim(raw)) NOT IN ('0', 'false', 'non', 'off') END AS enabled FROM raw")
def config_clamp(spark, sf_dir):
    raw = F.col("raw")
    return raw_values(spark, sf_dir).select("event_id", sheet.clamp_or(raw, 2, 40, 24, "int").alias("colors"), sheet.clamp_or(raw, 0.0, 12.0, 4.0).alias("delta_e"), sheet.bool_or(raw).alias("enabled"))


@query(QUERIES, "WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'A3' WHEN 1 THEN 'a4' WHEN 2 THEN 'Paysage' ELSE 'INLINE' END AS raw FROM orders) SELECT o_orderkey, CASE WHEN lower(raw) = 'a3' THEN 'a3' ELSE 'a4' END AS page_format, CASE WHEN lower(raw) IN ('paysage', 'landscape') THEN 'landscape' ELSE 'portrait' END AS orientation, CASE WHEN lower(raw) = 'inline' THEN 'inline' ELSE 'separate' END AS palette_layout FROM r")
def enum_normalise(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "A3").when(k == 1, "a4").when(k == 2, "Paysage").otherwise("INLINE")
    return table(spark, sf_dir, "orders").select("o_orderkey", sheet.page_format_of(raw).alias("page_format"), sheet.orientation_of(raw).alias("orientation"), sheet.palette_layout_of(raw).alias("palette_layout"))


@query(QUERIES, """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'detaille' ELSE 'other' END AS c FROM orders)
 SELECT o_orderkey, CASE c WHEN 'simple' THEN 620.0 WHEN 'detaille' THEN 1350.0 ELSE 900.0 END::DOUBLE AS superpixels, CASE c WHEN 'simple' THEN 14.0 WHEN 'detaille' THEN 6.0 ELSE 9.0 END::DOUBLE AS min_region_area_mm2,
 CASE c WHEN 'simple' THEN 8.0 WHEN 'detaille' THEN 4.0 ELSE 6.0 END::DOUBLE AS subject_min_region_area_mm2, CASE c WHEN 'simple' THEN 36.0 WHEN 'detaille' THEN 20.0 ELSE 28.0 END::DOUBLE AS background_min_region_area_mm2,
 CASE c WHEN 'simple' THEN 0.35 WHEN 'detaille' THEN 0.55 ELSE 0.45 END::DOUBLE AS background_superpixel_ratio, CASE c WHEN 'simple' THEN 4.0 WHEN 'detaille' THEN 2.0 ELSE 3.0 END::DOUBLE AS background_smoothing_radius,
 CASE c WHEN 'simple' THEN 3.5 WHEN 'detaille' THEN 2.0 ELSE 3.0 END::DOUBLE AS detail_min_region_area_mm2, CASE c WHEN 'simple' THEN 2.0 ELSE 1.0 END::DOUBLE AS contour_smoothing_iterations FROM r""")
def complexity_preset(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    value = F.when(k == 0, "simple").when(k == 1, "detaille").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in sheet.preset(value).items()])


_RULES_SQL = {
    "colors": "colors < 2 OR colors > 40 OR (subject_mode <> 'none' AND colors < 4)", "max_side": "w < 64 OR w > 8000", "superpixels": "superpixels < 10 OR superpixels > 20000", "smoothing_radius": "radius < 0 OR radius > 8", "margin_mm": "margin < 0", "preprocess_sigma_color": "sigma < 0.001 OR sigma > 0.25",
    "subject_color_ratio": "ratio < 0.5 OR ratio > 0.85", "page_format": "paper NOT IN ('a3', 'a4')", "connectivity": "connectivity NOT IN (4, 8)", "merge_strategy": "strategy NOT IN ('color', 'boundary', 'balanced')", "subject_mode": "subject_mode NOT IN ('none', 'ai', 'manual')",
    "min_region_area_mm2": "area <= 0", "number_font_mm": "font <= 0", "min_number_font_mm": "1.8 > font", "sample_pixels": "sample < colors",
}
_GIVEN_SQL = """given AS (SELECT p_partkey, p_size % 47 - 1 AS colors, p_size * 250 - 300 AS w, p_size * 500 - 600 AS superpixels, p_size % 12 - 2 AS radius, p_size % 9 - 1.0::DOUBLE AS margin, p_size * 0.006::DOUBLE AS sigma, p_size * 0.02::DOUBLE AS ratio,
 CASE p_size % 3 WHEN 0 THEN 'a3' WHEN 1 THEN 'a4' ELSE 'letter' END AS paper, 4 + p_size % 5 AS connectivity, CASE p_size % 4 WHEN 0 THEN 'color' WHEN 1 THEN 'boundary' WHEN 2 THEN 'balanced' ELSE 'other' END AS strategy, CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'ai' WHEN 2 THEN 'manual' ELSE 'auto' END AS subject_mode,
 p_size % 6 - 1.0::DOUBLE AS area, p_size % 5 - 1.0::DOUBLE AS font, p_size % 60 AS sample FROM part)"""


@query(QUERIES, f"WITH {_GIVEN_SQL} SELECT p_partkey, list_sort(list_filter([{', '.join(f'CASE WHEN {rule} THEN {name!r} END' for name, rule in _RULES_SQL.items())}], lambda x: x IS NOT NULL)) AS violations FROM given")
def config_violations(spark, sf_dir):
    """Every part as a set of parameters, checked by the pipeline's own rules."""
    size = F.col("p_size")
    named = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (size % k + 1).cast("int"))
    given = {
        "colors": size % 47 - 1, "max_side": size * 250 - 300, "superpixels": size * 500 - 600, "smoothing_radius": size % 12 - 2, "margin_mm": size % 9 - 1.0, "preprocess_sigma_color": size * 0.006, "subject_color_ratio": size * 0.02,
        "page_format": named(3, "a3", "a4", "letter"), "connectivity": 4 + size % 5, "merge_strategy": named(4, "color", "boundary", "balanced", "other"), "subject_mode": named(4, "none", "ai", "manual", "auto"), "min_region_area_mm2": size % 6 - 1.0,
        "number_font_mm": size % 5 - 1.0, "sample_pixels": size % 60,
    }
    return table(spark, sf_dir, "part").select("p_partkey", violations(given).alias("violations"))


@query(QUERIES, "SELECT conv_id, turn, role, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, octet_length(encode(text)) <= 400 AS accepted, text FROM conversations")
def data_url_decode(spark, sf_dir):
    """Payloads encoded as data URLs and decoded again, with a size limit."""
    raw = decode_data_url(sinks.data_url(F.col("text").cast("binary"), "text/plain"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.octet_length(raw).cast("long").alias("bytes"), (F.octet_length(raw) <= 400).alias("accepted"), raw.cast("string").alias("text"))


@query(QUERIES, "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def notes_topk(spark, sf_dir):
    """The 20 latest rows; a limit is what the operator is for."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)


@query(QUERIES, "SELECT conv_id, turn, trim(text) AS title, '' AS content FROM conversations WHERE length(trim(text)) > 0")
def notes_insert(spark, sf_dir):
    """Rows that an insert returns: titles must not be blank."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.trim("text").alias("title"), F.lit("").alias("content")).where("length(title) > 0")


@query(QUERIES, "SELECT conv_id, turn, role, trim(text) AS title, '' AS content, 1099511627776 + row_number() OVER (ORDER BY conv_id, turn, role, trim(text)) AS id FROM conversations WHERE length(trim(text)) > 0")
def notes_returning(spark, sf_dir):
    """Every message inserted into a fresh table as a note; the rows that the insert gives back, with their ids."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("title"), F.lit("").alias("content"))
    return inserts.insert(rows, scratch_path(spark, "notes"), "first", ["conv_id", "turn", "role", "title"])
