"""Tiles with margins, seams, parallel merging and list ranking against whole-image kernels."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.operators import graph, kernels, parallel_merge, tiles, tracing

SIDE = 16
#: Heights and widths: less than a tile, ragged, one row, one column, several tiles.
SHAPES = [(7, 9), (37, 50), (1, 40), (40, 1), (48, 64)]
COLOURS = np.array([[20.0, 10.0, -30.0], [55.0, 40.0, 20.0], [85.0, -5.0, 60.0]])


def blobs(rng, shape, classes):
    """Classes in patches of several sizes."""
    coarse = rng.integers(0, classes, (shape[0] // 5 + 1, shape[1] // 5 + 1))
    out = np.kron(coarse, np.ones((5, 5), int))[: shape[0], : shape[1]]
    noise = rng.random(shape) < 0.25
    return np.where(noise, rng.integers(0, classes, shape), out)


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(11)
    out = {}
    for i, shape in enumerate(SHAPES):
        smooth = kernels.gaussian(rng.random(shape), 1.5)
        out[i] = {"p": blobs(rng, shape, 3).astype(np.int32), "v": (smooth - smooth.min()) / max(1e-9, np.ptp(smooth)), "mask": blobs(rng, shape, 2).astype(bool), "b": blobs(rng, shape, 4).astype(np.int32)}
    return out


@pytest.fixture(scope="module")
def pixels(spark, images):
    frames = []
    for i, image in images.items():
        y, x = np.mgrid[: image["p"].shape[0], : image["p"].shape[1]]
        frames.append(pd.DataFrame({"image_id": np.int32(i), "x": x.ravel().astype(np.int32), "y": y.ravel().astype(np.int32)} | {c: a.ravel() for c, a in image.items()}))
    return spark.createDataFrame(pd.concat(frames, ignore_index=True)).repartition(4).cache()


def dense(rows, images, column):
    """Each image's column as an array; every pixel must be there once."""
    out = {i: np.zeros(image["p"].shape, object) for i, image in images.items()}
    seen = Counter()
    for r in rows.select("image_id", "x", "y", column).collect():
        out[r["image_id"]][r["y"], r["x"]] = r[column]
        seen[r["image_id"], r["x"], r["y"]] += 1
    assert set(seen.values()) <= {1} and len(seen) == sum(a.size for a in out.values())
    return out


def equal(rows, images, column, kernel):
    for i, found in dense(rows, images, column).items():
        assert np.array_equal(found, kernel(images[i])), i


def test_filters_are_bit_equal(pixels, images):
    equal(tiles.gaussian(pixels, "v", 0.65, SIDE), images, "blurred", lambda m: kernels.gaussian(m["v"], 0.65))
    twice = lambda m: kernels.bilateral(kernels.bilateral(m["v"], 0.055, 3.0), 0.08, 4.95)
    equal(tiles.bilateral(pixels, ["v"], [(0.055, 3.0), (0.08, 4.95)], SIDE), images, "soft_v", twice)


def test_a_margin_that_is_too_narrow_shows(pixels, images):
    narrow = tiles.map_tiles(pixels, lambda a, _: {"blurred": kernels.gaussian(a["v"], 2.0)}, ["v"], 1, "blurred double", SIDE)
    found = dense(narrow, images, "blurred")
    assert not np.array_equal(found[4], kernels.gaussian(images[4]["v"], 2.0)) and np.array_equal(found[0], kernels.gaussian(images[0]["v"], 2.0))


def test_bilateral_over_channels(pixels, images):
    soft = tiles.bilateral(pixels.withColumn("w", 1 - F.col("v")), ["v", "w"], [(0.1, 2.0)], SIDE)
    for c, k in (("soft_v", 0), ("soft_w", 1)):
        equal(soft, images, c, lambda m, k=k: kernels.bilateral(np.stack([m["v"], 1 - m["v"]], -1), 0.1, 2.0)[..., k])


@pytest.mark.parametrize("low, high", [(0.045, 0.16), (0.01, 0.05)])
def test_canny(pixels, images, low, high):
    want = lambda m: kernels.canny(m["v"], 1.05, low, high)
    assert low > 0.02 or want(images[4]).sum() > 20
    equal(tiles.canny(pixels, "v", 1.05, low, high, SIDE), images, "edge", want)


def test_thinning_and_strokes(pixels, images):
    equal(tiles.thinned(pixels, "mask", "thin", SIDE), images, "thin", lambda m: kernels.thin(m["mask"]))
    equal(tiles.line_art(pixels, "v", "mask", "b", SIDE), images, "stroke", lambda m: kernels.line_art(m["v"], m["mask"], None, m["b"], 0.65))


@pytest.mark.parametrize("connectivity", [4, 8])
def test_regions_over_seams(pixels, images, connectivity):
    equal(tiles.connected_regions(pixels, "p", connectivity, SIDE), images, "region_id", lambda m: kernels.label_components(m["p"], np.ones(m["p"].shape, bool), connectivity))


def test_one_component_and_its_number(spark, pixels, images):
    one = tiles.components(pixels.withColumn("p", F.lit(1)), "p", 4, SIDE)
    assert {(r["image_id"], r["component"]) for r in one.select("image_id", "component").distinct().collect()} == {(i, 0) for i in images}
    sparse = spark.createDataFrame([(0, 3, 2, True), (0, 40, 2, True), (0, 40, 3, True)], "image_id int, x int, y int, m boolean")
    assert {(r["x"], r["y"], r["component"]) for r in tiles.components(sparse, "m", 4, SIDE).collect()} == {(3, 2, 2 * 41 + 3), (40, 2, 2 * 41 + 40), (40, 3, 2 * 41 + 40)}
    assert tiles.components(sparse.limit(0), "m", 4, SIDE).collect() == []


def test_a_spiral_crosses_many_seams(spark):
    n, spiral, x, y, dx, dy = 41, np.zeros((41, 41), bool), 0, 0, 1, 0
    for _ in range(n * n):
        spiral[y, x] = True
        ahead = (y + 2 * dy, x + 2 * dx)
        if not (0 <= y + dy < n and 0 <= x + dx < n) or (0 <= ahead[0] < n and 0 <= ahead[1] < n and spiral[ahead]):
            dx, dy = -dy, dx
            if not (0 <= y + dy < n and 0 <= x + dx < n) or spiral[y + dy, x + dx]:
                break
        x, y = x + dx, y + dy
    rows = spark.createDataFrame([(0, int(c), int(r), bool(spiral[r, c])) for r in range(n) for c in range(n)], "image_id int, x int, y int, m boolean")
    found = tiles.components(rows, "m", 4, 4)
    parts = kernels.label_components(spiral.astype(int), np.ones(spiral.shape, bool), 4)
    assert found.select("component").distinct().count() == parts.max()


def test_masks(pixels, images):
    equal(tiles.filled(pixels, side=SIDE), images, "filled", lambda m: kernels.fill_holes(m["mask"]))
    equal(tiles.cleaned(pixels, side=SIDE), images, "clean", lambda m: kernels.clean_mask(m["mask"]))
    equal(tiles.large(pixels, "mask", F.lit(9), 8, "kept", SIDE), images, "kept", lambda m: kernels.keep_large(m["mask"], 9, 8))


def test_adjacency(pixels, images):
    found = {(r["image_id"], r["region_a"], r["region_b"]): r["boundary_pixels"] for r in tiles.adjacency(pixels, "b", SIDE).collect()}
    want = {(i, a - 1, b - 1): n for i, m in images.items() for a, b, n in kernels.shared_sides(m["b"] + 1)}
    assert found == want


def test_distances(pixels, images):
    equal(tiles.distances(pixels, "p"), images, "d", lambda m: kernels.distance_to_outside(m["p"]))
    flat = tiles.distances(pixels.withColumn("p", F.lit(1)), "p")
    equal(flat, images, "d", lambda m: kernels.distance_to_outside(np.ones_like(m["p"])))
    assert set(flat.columns) == {*pixels.columns, "d"} and tiles.distances(pixels.limit(0), "p").collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 60), st.integers(0, 2**32), st.sampled_from([1, 3, 40, 5000]))
def test_envelopes_are_least_parabolas(rows, width, seed, most):
    steps = np.random.default_rng(seed).integers(0, most + 1, (rows, width))
    x = np.arange(width)
    assert np.array_equal(kernels.row_envelopes(steps), ((x[:, None] - x[None]) ** 2 + steps[:, None, :] ** 2).min(axis=2))


@pytest.mark.parametrize("least", [1, 12, 10_000])
def test_merges_equal_the_queue(pixels, images, least):
    regions = tiles.connected_regions(pixels.select("image_id", "x", "y", "p"), "p", 4, SIDE).cache()
    got = Counter(tuple(r) for r in parallel_merge.merge_log(regions, COLOURS, least, side=8).collect())
    want, merged = Counter(), {}
    for i, m in images.items():
        labels = kernels.label_components(m["p"], np.ones(m["p"].shape, bool), 4)
        classes = {int(r): int(m["p"][labels == r][0]) for r in np.unique(labels)}
        after, after_classes, log = kernels.merge_image(labels, classes, dict.fromkeys(classes, least), COLOURS, "balanced", 35.0)
        want.update((*e, i) for e in log)
        merged[i] = after
    assert got == want and (least == 1) == (not want)
    equal(parallel_merge.merge_small_regions(regions, COLOURS, least, side=8), images, "merged_region", lambda m: merged[next(i for i, o in images.items() if o is m)])


def test_traces_of_boundaries_and_skeletons(pixels, images):
    found = tracing.boundary_lines(pixels, "p").orderBy("image_id", "path_id").collect()
    for i, m in images.items():
        want = kernels.trace(kernels.boundary_edges(m["p"]))
        assert [[(p["x"], p["y"]) for p in r["points"]] for r in found if r["image_id"] == i] == [list(map(tuple, q)) for q in want]
        assert [r["path_id"] for r in found if r["image_id"] == i] == list(range(len(want)))
    thin = tiles.thinned(pixels, "mask", "thin", SIDE)
    strokes = tracing.skeleton_lines(thin, "thin").orderBy("image_id", "path_id").collect()
    for i, m in images.items():
        assert [[(p["x"], p["y"]) for p in r["points"]] for r in strokes if r["image_id"] == i] == kernels.skeleton_paths(kernels.thin(m["mask"]))


def test_traces_of_any_graph(spark):
    """Every edge once, in the paths of the walk; a path may only be turned round."""
    rng = np.random.default_rng(4)
    graphs = {g: rng.integers(0, rng.integers(2, 11), (rng.integers(1, 26), 2)).tolist() for g in range(60)}
    table = spark.createDataFrame([(g, a, b) for g, pairs in graphs.items() for a, b in pairs], "image_id int, a long, b long")
    paths = defaultdict(dict)
    for r in tracing.trace(table).collect():
        paths[r["image_id"], r["path_id"]][r["position"]] = r["node"]
    turn = lambda p: min(tuple(p), tuple(p[::-1]))
    for g, pairs in graphs.items():
        edges = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
        found = [[p[k] for k in range(len(p))] for (i, _), p in paths.items() if i == g]
        assert Counter((min(a, b), max(a, b)) for p in found for a, b in zip(p, p[1:])) == Counter(edges)
        assert Counter(map(turn, found)) == Counter(turn([n for n, _ in p]) for p in kernels.trace([((a, 0), (b, 0)) for a, b in edges]))


def test_a_long_ring_and_simplified_lines(spark):
    ring = spark.createDataFrame([(0, i, (i + 1) % 1000) for i in range(1000)], "image_id int, a long, b long")
    nodes = [r["node"] for r in tracing.trace(ring).orderBy("position").collect()]
    assert nodes == [*range(1000), 0]
    line = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.1), (2.0, 0.0), (3.0, 4.0)],)], "points array<struct<x: double, y: double>>")
    assert [tuple(p) for p in line.select(tracing.simplified("points", 0.4).alias("s")).first()["s"]] == [(0.0, 0.0), (2.0, 0.0), (3.0, 4.0)]


def test_contraction(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(i), int(a), int(b)) for i, a, b in zip(rng.integers(0, 2, 300), rng.integers(0, 200, 300), rng.integers(0, 200, 300))]
    pairs += [(2, i, i + 1) for i in range(60)] + [(3, 0, i) for i in range(1, 50)] + [(4, 99, i) for i in range(50)]
    found = {(r["image_id"], r["node"]): r["component"] for r in graph.contract(spark.createDataFrame(pairs, "image_id int, a long, b long")).collect()}
    least = {(i, n): n for i, a, b in pairs for n in (a, b) if a != b}
    for _ in range(200):
        for i, a, b in pairs:
            if a != b:
                least[i, a] = least[i, b] = min(least[i, a], least[i, b])
    assert found == least


def test_only_rows_of_images_are_sent_out_whole(spark, monkeypatch):
    """Files of pixels are small for their rows; joins of pixels and components must not leave them to the driver."""
    plans = []

    def kept(rows, name, write=tiles.materialize):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, name)

    for module in (tiles, graph):
        monkeypatch.setattr(module, "materialize", kept)
    noise = spark.range(2 * 64 * 64).select(F.floor(F.col("id") / 4096).cast("int").alias("image_id"), (F.col("id") % 64).cast("int").alias("x"), (F.floor(F.col("id") / 64) % 64).cast("int").alias("y"), F.rand(3).alias("v"))
    plans.append(tiles.canny(noise, "v", 1.05, 0.01, 0.05, SIDE)._jdf.queryExecution().executedPlan().toString())
    keys = [re.search(r"HashedRelationBroadcastMode\((List\(.*?)\),?\s*(?:false|true)", line) for plan in plans for line in plan.splitlines() if "BroadcastExchange" in line]
    assert len(plans) > 5 and [k and k[1] for k in keys if not k or k[1].count("input[") != 1 or "input[0, int" not in k[1]] == []
