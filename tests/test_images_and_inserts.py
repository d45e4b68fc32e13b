"""Resizing, numbers on sheets, outlines, k-means starts and inserts that give back their rows."""

import re
import threading
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import kernels, kmeans, resample
from rasterloom.plans.config import Config
from rasterloom.plans.sheets import make_sheet, on_page
from rasterloom.sources import images, inserts, sinks

# --- resizing -------------------------------------------------------------------------------------------------------


def test_weights_of_half_and_double_size():
    """Literal weights of the two filters."""
    first, weights = resample.filter_weights(4, 2, "triangle")
    assert first.tolist() == [0, 1] and np.allclose(weights * 7, [[3, 3, 1], [1, 3, 3]])
    first, weights = resample.filter_weights(2, 4, "triangle")
    assert np.allclose([w @ np.array([0.0, 100.0])[f : f + 2] if f == 0 else w[:1] @ [100.0] for f, w in zip(first, weights)], [0, 25, 75, 100])
    _, weights = resample.filter_weights(100, 50, "lanczos")
    assert np.allclose(weights.sum(axis=1), 1) and (weights < 0).any()


def test_resizing_literal_images():
    ramp = np.tile(np.arange(0, 256, 255 / 7), (8, 1))
    assert resample.resize(ramp, 4, 4, "triangle")[0].tolist() == [26, 91, 164, 229]
    assert np.abs(resample.resize(ramp, 4, 4, "lanczos")[0] - [17, 91, 164, 238]).max() <= 3
    flat = np.full((9, 13, 3), 77)
    assert (resample.resize(flat, 5, 4, "lanczos") == 77).all() and resample.resize(flat, 13, 9, "lanczos").shape == (9, 13, 3)
    step = np.repeat([[0.0, 255.0]], 20, axis=1)
    out = resample.resize(np.repeat(step, 4, axis=0), 10, 4, "lanczos")
    assert out.min() == 0 and out.max() == 255 and (np.diff(out[0][4:6]) > 100).all()


def test_resized_tables_equal_arrays(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (11, 17))
    y, x = np.mgrid[:11, :17]
    table = spark.createDataFrame(pd.DataFrame({"image_id": 1, "x": x.ravel(), "y": y.ravel(), "v": image.ravel()})).repartition(3)
    for kind, width, height in (("lanczos", 6, 5), ("triangle", 40, 3), ("triangle", 17, 11)):
        got = np.full((height, width), np.nan)
        for r in resample.resized(table, "v", width, height, kind).collect():
            got[r["y"], r["x"]] = r["v"]
        assert np.allclose(got, resample.along(resample.along(image.astype(float), width, kind).T, height, kind).T)
    assert resample.resized(table.limit(0), "v", 3, 3).collect() == []


def test_masks_are_sized_and_cleaned(spark):
    image = np.zeros((40, 40, 3), int)
    image[8:32, 8:32] = 255
    image[15:17, 15:17] = 0  # a hole
    image[2, 2] = 255  # a speck
    y, x = np.mgrid[:40, :40]
    rows = spark.createDataFrame(pd.DataFrame({"image_id": "m", "x": x.ravel(), "y": y.ravel(), "r": image[..., 0].ravel(), "g": image[..., 1].ravel(), "b": image[..., 2].ravel(), "alpha": 255}))
    got = images.sized_mask(rows, 20, 20).where("subject").select("x", "y").collect()
    assert {(r["x"], r["y"]) for r in got} == {(a, b) for a in range(4, 16) for b in range(4, 16)}


# --- sheets ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sheet():
    rgb = np.zeros((120, 160, 3))
    rgb[:, :80], rgb[:, 80:] = (200, 60, 60), (60, 90, 200)
    rgb[30:90, 50:110] = (240, 220, 90)
    subject = np.zeros((120, 160), bool)
    subject[30:90, 50:110] = True
    subject[50:70, 70:90] = False
    config = Config(colors=6, superpixels=60, subject_mode="manual", min_region_area_mm2=4.0)
    return make_sheet(rgb, config, subject), rgb


def drawn(png):
    """The pixels of an RGB PNG."""
    at, data = 8, b""
    width, height = (int.from_bytes(png[k : k + 4], "big") for k in (16, 20))
    while at < len(png):
        size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        data += png[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(height, width, 3)


def test_numbers_are_on_the_png_and_in_the_pdf(sheet):
    made, _ = sheet
    placed = [r for r in made["labels"] if r["status"] == "placed"]
    coloring = drawn(made["images"]["coloring"])
    assert placed
    for r in placed:
        mask = sinks.number_mask(str(r["number"]), r["font_size_mm"] / made["mm_per_pixel"])
        top, left = round(r["y_px"] - mask.shape[0] / 2), round(r["x_px"] - mask.shape[1] / 2)
        assert (coloring[top : top + mask.shape[0], left : left + mask.shape[1]][mask] == 34).all()
    shown = re.findall(rb"BT [^(]* Td \((\d+)\) Tj ET", made["pdf"])
    assert sorted(shown) == sorted(str(r["number"]).encode() for r in placed)
    assert b"/BaseFont /Helvetica" in made["pdf"] and made["pdf"].count(b"/Type /Page ") == 2


def test_pdf_numbers_stand_at_their_places():
    page = sinks.Page(np.full((10, 10, 3), 255), (20, 30, 100, 50), ((70.0, 55.0, 4.0, "12"),))
    text = sinks.pdf([page, np.zeros((5, 5, 3))], 210, 297).decode("latin-1")
    width, height, left, low = map(float, re.search(r"q ([\d.]+) 0 0 ([\d.]+) ([\d.]+) ([\d.]+) cm", text).groups())
    mm = 25.4 / 72
    assert np.allclose([width * mm, height * mm, left * mm, 297 - low * mm], [100, 50, 20, 80], atol=1e-3)
    size, x, y = map(float, re.search(r"/F ([\d.]+) Tf ([\d.]+) ([\d.]+) Td \(12\)", text).groups())
    assert np.allclose([size * mm, x * mm + 0.278 * 4 * 2, 297 - (y * mm + 0.35 * 4)], [4, 70, 55], atol=1e-3)
    for place in re.findall(r"^(\d{10}) 00000 n", text, re.M):  # the table points at the objects
        assert re.match(r"\d+ 0 obj", text[int(place) :])


def test_digits_differ_and_are_cut_off_at_the_border():
    masks = {sinks.number_mask(str(d), 10).tobytes() for d in range(10)}
    assert len(masks) == 10 and sinks.number_mask("1", 0.1).shape == (5, 3)
    blank = np.full((8, 8, 3), 255)
    assert (sinks.draw_numbers(blank, [(0.0, 0.0, 9.0, "88"), (50.0, 50.0, 9.0, "1")]) == 34).any() and (blank == 255).all()


def test_the_sheet_has_the_subjects_outline(sheet):
    made, rgb = sheet
    outlines = re.findall(r'<path d="([^"]+)" fill="none" stroke="black"', made["svg"])
    assert len(outlines) == 2  # outside and the hole
    assert 'stroke="black"' not in make_sheet(rgb, Config(colors=6, superpixels=60))["svg"]
    assert on_page(rgb, 0.7).shape[0] > rgb.shape[0]


@pytest.mark.parametrize("seed", range(4))
def test_nesting_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    mask = np.kron(rng.integers(0, 2, (9, 9)), np.ones((4, 4), int)).astype(bool)
    mask[3:33, 3:33] ^= rng.random((30, 30)) < 0.1
    rings = kernels.mask_contours(mask)
    nested = kernels.nest_rings(rings)
    for i, (parent, depth) in enumerate(nested):
        around = [j for j in range(len(rings)) if j != i and abs(kernels.ring_area(rings[j])) > abs(kernels.ring_area(rings[i])) and kernels.surrounds(rings[j], rings[i][0])]
        assert depth == len(around) and (parent == -1) == (not around) and (parent == -1 or nested[parent][1] == depth - 1)
    # outlines less holes are the mask's area, but for the corners cut at every turn
    signed = sum(abs(kernels.ring_area(r)) * (1 if d % 2 == 0 else -1) for r, (_, d) in zip(rings, nested))
    assert signed == pytest.approx(mask.sum(), abs=0.13 * sum(map(len, rings)))


# --- k-means --------------------------------------------------------------------------------------------------------


def lloyd(points, centres, rounds=40):
    for _ in range(rounds):
        near = np.square(points[:, None] - centres[None]).sum(-1).argmin(1)
        centres = np.array([points[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return np.square(points[:, None] - centres[None]).sum(-1).min(1).sum()


def test_kmeans_is_no_worse_than_ten_runs(spark):
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(c, 1.0 + i % 3, (60, 3)) for i, c in enumerate(rng.uniform(-60, 60, (7, 3)))]).round(4)
    table = spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>")
    centres, cost = kmeans.fit(table.repartition(5), 7, 3)
    again, same = kmeans.fit(table.repartition(2), 7, 3)
    assert np.array_equal(centres, again) and cost == same
    best = min(lloyd(points, points[rng.choice(len(points), 7, replace=False)]) for _ in range(10))
    assert cost <= best * 1.001 and cost == pytest.approx(np.square(points[:, None] - centres[None]).sum(-1).min(1).sum(), rel=1e-3)


def test_kmeans_of_few_points(spark):
    rows = [([1.0, 2.0],), ([1.0, 2.0],), ([3.0, 4.0],), ([None, 1.0],), (None,), ([float("nan"), 0.0],), ([1.0],)]
    table = spark.createDataFrame(rows, "v array<double>")
    centres, cost = kmeans.fit(table, 5, 2)
    assert centres.tolist() == [[1.0, 2.0], [3.0, 4.0]] and cost == 0
    one, _ = kmeans.fit(table, 1, 2)
    assert one.round(3).tolist() == [[1.667, 2.667]]
    assert kmeans.fit_centres(table.limit(0), 3, 2).collect() == []


# --- inserts --------------------------------------------------------------------------------------------------------


@pytest.fixture
def notes(spark, tmp_path):
    rows = spark.createDataFrame([(" b ", "x"), ("a", None), ("  ", "blank"), (None, "none"), ("c", "z")], "title string, content string")
    return rows, f"file://{tmp_path}/notes"


def test_insert_gives_back_its_rows_once(spark, notes):
    rows, path = notes
    first = inserts.insert(rows, path, "one", ["title"])
    got = [tuple(r) for r in first.orderBy("id").collect()]
    assert [(t, c) for t, c, _ in got] == [("a", None), ("b", "x"), ("c", "z")] and [i - got[0][2] for *_, i in got] == [0, 1, 2]
    assert [tuple(r) for r in inserts.insert(rows, path, "one", ["title"]).orderBy("id").collect()] == got
    second = inserts.insert(rows, path, "two", ["title"]).orderBy("id").collect()
    assert min(r["id"] for r in second) > max(i for *_, i in got)
    every = inserts.read(spark, path, rows.schema)
    assert every.count() == 6 and every.select("id").distinct().count() == 6
    assert inserts.insert(rows.limit(0), path, "none", ["title"]).collect() == [] and inserts.read(spark, path, rows.schema).count() == 6
    with pytest.raises(ValueError):
        inserts.insert(rows, path, "../out", ["title"])


def test_inserts_at_the_same_time(spark, notes):
    rows, path = notes
    assert inserts.read(spark, path, rows.schema).collect() == []
    tokens, failed = ["a", "b", "c", "a", "b"], []

    def work(token):
        try:
            assert inserts.insert(rows, path, token, ["title"]).count() == 3
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=work, args=(t,)) for t in tokens]
    [t.start() for t in threads]
    [t.join() for t in threads]
    every = inserts.read(spark, path, rows.schema)
    assert not failed and every.count() == 9 and every.select("id").distinct().count() == 9


def test_unfinished_inserts_are_not_seen(spark, notes):
    rows, path = notes
    folder = inserts._Folder(spark, path)
    inserts._stage(folder, rows.where("title = 'c'"), "_staging/left-behind", ["title"])
    assert inserts.read(spark, path, rows.schema).collect() == []
    assert inserts.insert(rows, path, "left", ["title"]).count() == 3
    assert {r["id"] >> inserts.PLACE_BITS for r in inserts.read(spark, path, rows.schema).collect()} == {2}
