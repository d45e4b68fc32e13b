"""The sheets' array steps and the column operators of the same name give the same."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color, sheet
from rasterloom.operators import grid, kernels, palette, regions, tiles
from rasterloom.plans import sheets
from rasterloom.plans.config import Config

HEIGHT, WIDTH, CLASSES = 30, 44, 4


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(21)
    classes = np.kron(rng.integers(0, CLASSES, (6, 11)), np.ones((5, 4), int))
    classes[rng.random(classes.shape) < 0.06] = 1
    ids = kernels.label_components(classes, np.ones(classes.shape, bool), 4)
    return {"p": classes.astype(np.int32), "region_id": ids, "r": rng.integers(0, 256, classes.shape), "g": rng.integers(0, 256, classes.shape), "b": rng.integers(0, 256, classes.shape), "block": (np.arange(HEIGHT)[:, None] // 6 * 10 + np.arange(WIDTH) // 7).astype(np.int32)}


@pytest.fixture(scope="module")
def pixels(spark, image):
    y, x = np.mgrid[:HEIGHT, :WIDTH]
    return spark.createDataFrame(pd.DataFrame({"image_id": 0, "x": x.ravel().astype(np.int32), "y": y.ravel().astype(np.int32)} | {c: a.ravel() for c, a in image.items()})).repartition(3).cache()


def dense(rows, column):
    out = np.empty((HEIGHT, WIDTH), object)
    for r in rows.select("x", "y", column).collect():
        out[r["y"], r["x"]] = r[column]
    return out


def classes_of(image):
    return {int(r): int(image["p"][image["region_id"] == r][0]) for r in np.unique(image["region_id"])}


def test_lab(pixels, image):
    lab = sheets.lab_image(np.stack([image[c] for c in "rgb"], -1).astype(float))
    rows = pixels.select("x", "y", *[c.alias(n) for n, c in zip(("l", "a", "b"), color.rgb_to_lab(*(F.col(c) for c in "rgb")))])
    for i, c in enumerate(("l", "a", "b")):
        assert np.allclose(dense(rows, c).astype(float), lab[..., i], atol=1e-9)


@pytest.mark.parametrize("radius", [1, 2])
def test_modes(pixels, image, radius):
    assert np.array_equal(dense(grid.mode_filter(pixels.select("image_id", "x", "y", "p"), range(CLASSES), radius), "smoothed"), sheets.smooth_modes(image["p"], radius, CLASSES))


def test_votes(pixels, image):
    won = {r["block"]: r["winner"] for r in palette.superpixel_vote(pixels, "block").collect()}
    assert np.array_equal(np.vectorize(won.get)(image["block"]), sheets.vote(image["p"], image["block"], CLASSES))


def test_regions(pixels, image):
    scale, least = 0.25, 20
    want = {r["region_id"]: r for r in sheets.region_rows(image["region_id"], classes_of(image), least, Config(thin_width_mm=1.6), scale)}
    rows = regions.region_geometry(pixels, scale, least).join(tiles.thickness(pixels, scale, 1.6), ["image_id", "region_id"]).collect()
    assert {r["region_id"] for r in rows} == set(want)
    for r in rows:
        own = want[r["region_id"]]
        for name in ("palette_index", "pixel_count", "min_x", "min_y", "max_x", "max_y", "width", "height", "is_below_area_threshold", "is_thin"):
            assert r[name] == own[name], name
        for name in ("pixel_percent", "area_mm2", "centroid_x", "centroid_y", "max_thickness_mm", "aspect_ratio", "compactness"):
            assert r[name] == pytest.approx(own[name], abs=1e-9), name


def test_edges_and_label_places(pixels, image):
    ids, classes = image["region_id"], classes_of(image)
    edges = {(r["region_a"], r["region_b"]): r["boundary_pixels"] for r in grid.adjacency(pixels, "region_id").collect()}
    assert edges == {(e["region_a"], e["region_b"]): e["boundary_pixels"] for e in sheets.edge_rows(ids, classes, np.zeros((CLASSES, 3)))}
    labels = sheets.place_labels(ids, classes, Config(), 0.25, kernels.distance_to_outside(ids))
    places = {r["region_id"]: (r["x_px"], r["y_px"]) for r in tiles.label_anchors(pixels).collect()}
    assert places == {r["region_id"]: (r["x_px"], r["y_px"]) for r in labels}


@pytest.mark.parametrize("layout", ["separate", "inline"])
@pytest.mark.parametrize("page_format, orientation", [("a4", "portrait"), ("a3", "landscape")])
def test_pages(spark, layout, page_format, orientation):
    config = Config(page_format=page_format, orientation=orientation, palette_layout=layout)
    page_w, page_h, scale, left, top = sheets.page(config, 640, 480, 9)
    at = [F.lit(v) for v in (page_format, orientation, config.margin_mm)]
    reserved = sheet.legend_height(*at, F.lit(9)) if layout == "inline" else F.lit(0.0)
    own = spark.range(1).select(*[c.alias(n) for n, c in sheet.print_geometry(F.lit(640), F.lit(480), *at, F.lit(9.0), reserved).items()]).first()
    assert (page_w, page_h) == (own["page_width_mm"], own["page_height_mm"])
    assert (scale, left, top) == pytest.approx((own["mm_per_pixel"], own["image_origin_x_mm"], own["image_origin_y_mm"]))


@pytest.mark.parametrize("width, height", [(600, 400), (1100, 900), (2000, 1500)])
def test_tuning(spark, width, height):
    config = sheets.tuned(Config(auto_tune=True), width, height)
    plain = Config()
    values = [F.lit(v) for v in (plain.superpixels, plain.min_region_area_mm2, plain.subject_min_region_area_mm2, plain.background_min_region_area_mm2, plain.detail_min_region_area_mm2, plain.smoothing_radius)]
    own = spark.range(1).select(*[c.alias(n) for n, c in sheet.auto_tune(sheet.size_class(F.lit(width), F.lit(height)), *values).items()]).first()
    want = (config.superpixels, config.min_region_area_mm2, config.subject_min_region_area_mm2, config.background_min_region_area_mm2, config.detail_min_region_area_mm2, config.smoothing_radius)
    assert tuple(own) == pytest.approx(want)


@pytest.mark.parametrize("old, new", [((40, 30), (17, 60)), ((9, 7), (100, 3)), ((50, 50), (50, 50)), ((33, 8), (1, 1))])
def test_nearest_places(spark, old, new):
    (width, height), (new_width, new_height) = old, new
    rows = spark.range(width * height).select(F.lit(1).alias("image_id"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"), "id")
    got = {(r["x"], r["y"]): r["id"] for r in grid.resize_nearest(rows, width, height, new_width, new_height).collect()}
    under = lambda n, size, new_size: int((n + 0.5) * size / new_size)
    assert got == {(x, y): under(y, height, new_height) * width + under(x, width, new_width) for x in range(new_width) for y in range(new_height)}
