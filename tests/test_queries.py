"""Every registered raster query against its SQL, and the files."""

import os

import duckdb
import numpy as np
import pytest

from rasterloom.plans import catalog
from rasterloom.sources import images, sinks, zones

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(lambda v: str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    got, want = normal(catalog.queries()[name](spark, DATA).toPandas()), normal(oracle.sql(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all() or np.array_equal(got[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True), c


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_merging_conserves_pixels(spark):
    rows = catalog.queries()["merge_small_regions"](spark, DATA)
    log = catalog.queries()["merge_events"](spark, DATA)
    before, after, merges = rows.select("image_id", "region_id").distinct().count(), rows.select("image_id", "merged_region").distinct().count(), log.count()
    assert before - merges == after


def test_images_masks_and_tables(spark, tmp_path):
    image = np.zeros((40, 60, 3), np.uint8)
    image[:, :30] = (250, 10, 20)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.png").write_bytes(sinks.png(image))
    pixels = images.read_pixels(spark, str(tmp_path / "in"), 1200)
    assert pixels.count() == 2400
    assert {(r["r"], r["g"], r["b"]) for r in pixels.select("r", "g", "b").distinct().collect()} == {(250, 10, 20), (0, 0, 0)}
    small = images.read_pixels(spark, str(tmp_path / "in"), 30)
    assert small.count() == 600
    share = images.coverage(images.mask_of(pixels, 50)).first()
    assert share["coverage"] == 50.0 and share["accepted"]
    again = sinks.encode_png(pixels).first()["png"]
    assert bytes(again) == sinks.png(image)
    table = spark.createDataFrame([(1, 2, 3, 0, 1, 0.123456789)], "region_a long, region_b long, boundary_pixels long, palette_a int, palette_b int, delta_e76 double")
    with pytest.raises(ValueError, match="lacks palette_b"):
        sinks.write_table(table.drop("palette_b"), str(tmp_path / "lacking"), "adjacency")
    sinks.write_table(table, str(tmp_path / "edges"), "adjacency")
    assert spark.read.csv(str(tmp_path / "edges"), header=True).first()["delta_e76"] == "0.12346"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_table(table, str(tmp_path / "edges"), "adjacency")


def test_command_line_makes_sheets(spark, tmp_path):
    from rasterloom.plans.config import Config
    from rasterloom.plans.sheets import compare_strategies, run_images

    image = np.full((50, 70, 3), 240, np.uint8)
    image[10:40, 10:60] = (20, 90, 160)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.png").write_bytes(sinks.png(image))
    config = Config(colors=3, superpixels=40)
    run_images(spark, str(tmp_path / "in"), str(tmp_path / "out"), config)
    for kind, name in (("regions", "regions"), ("regions", "regions-before"), ("adjacency", "adjacency"), ("labels", "labels"), ("palette", "palette")):
        rows = spark.read.csv(str(tmp_path / "out" / name), header=True)
        assert rows.columns == ["image_id", *sinks.TABLES[kind][0]] and rows.count() >= 1
    assert sum(int(r["pixel_count"]) for r in spark.read.csv(str(tmp_path / "out" / "regions"), header=True).collect()) == 3500
    ids = spark.read.parquet(str(tmp_path / "out" / "region-ids"))
    assert ids.count() == 3500 and ids.select("x", "y").distinct().count() == 3500
    report = spark.read.json(str(tmp_path / "out" / "stats")).first()
    assert report["labeling"]["coverage_percent"] == 100.0 and report["regions_after"]["count"] == ids.select("region_after").distinct().count() and report["pixel_count"] == 3500
    compared = compare_strategies(images.read_pixels(spark, str(tmp_path / "in")), config).collect()
    assert {r["strategy"] for r in compared} == {"color", "boundary", "balanced"} and all(r["regions_before"] - r["merges"] == r["regions_after"] for r in compared)


def test_strategies_are_written_as_files(spark, tmp_path):
    """CSV, JSON and plate of two images against the rows and against merges of their own; what stands there is refused."""
    from pyspark.errors import AnalysisException

    from rasterloom.operators import kernels as k
    from rasterloom.plans import sheets
    from rasterloom.plans.config import Config

    rng, pixels, shapes = np.random.default_rng(4), [], {"one": (30, 44), "two": (25, 900)}
    pictures = {}
    for name, (height, width) in shapes.items():
        image = pictures[name] = np.kron(rng.integers(0, 255, (height // 5, -(-width // 4), 3)), np.ones((5, 4, 1), int))[:height, :width]
        pixels += [(name, x, y, *map(int, image[y, x])) for y in range(height) for x in range(width)]
    frame = spark.createDataFrame(pixels, "image_id string, x int, y int, r int, g int, b int")
    config = Config(colors=4, superpixels=60)
    path = str(tmp_path / "out")
    rows = sorted(sheets.export_comparison(frame, path, config).collect())
    assert len(rows) == 6 and {r["image_id"] for r in rows} == set(shapes)
    csv = spark.read.csv(f"{path}/strategies-comparison", header=True, schema=sheets.COMPARED)
    assert csv.columns == ["image_id", *sinks.TABLES["strategies"][0]] and sorted(csv.drop("duration_ms").collect()) == [r[:-1] for r in rows]
    assert sorted(tuple(r[c] for c in csv.columns[:-1]) for r in spark.read.json(f"{path}/strategies-comparison-json").collect()) == [r[:-1] for r in rows]
    plates = {r["image_id"]: r["plate"] for r in spark.read.parquet(f"{path}/strategies-comparison-plates").collect()}
    assert set(plates) == set(shapes)
    for name, (height, width) in shapes.items():
        own = sheets.tuned(config, width, height)
        made = sheets.segment(pictures[name].astype(float), own)
        panels = []
        for strategy in k.STRATEGIES:
            ids, classes, _ = sheets.merge(made, own, strategy, None)
            colours = np.array([[int(sheets.lab_hex(made.colours[classes[i]])[j : j + 2], 16) for j in (1, 3, 5)] for i in range(1, len(classes) + 1)])
            panels.append((np.where(k.boundary(ids)[..., None], 40, colours[ids - 1]), len(classes)))
        assert bytes(plates[name]) == sinks.png(sheets.strategy_plate(panels))
        drawn, wide = sheets.strategy_plate(panels), min(420, width)
        assert drawn.shape == (64 + round(height * wide / width), 3 * wide, 3) and (drawn[:64] == 34).any()
        if wide == width:
            assert all((drawn[64:, i * wide : (i + 1) * wide] == p).all() for i, (p, _) in enumerate(panels))
    with pytest.raises(AnalysisException):
        sheets.export_comparison(frame, path, config)


def test_strategies_differ_only_in_the_merge(spark):
    """Each strategy's row against a merge of its own."""
    from rasterloom.operators import kernels, merging
    from rasterloom.operators.regions import to_dense
    from rasterloom.plans import iterative_queries as q

    rows = {(r["image_id"], r["strategy"]): r for r in catalog.queries()["strategy_comparison"](spark, DATA).collect()}
    frame = q.labelled(spark, DATA).toPandas()
    for image, group in frame.groupby("image_id"):
        before, present = to_dense(group, "p")
        for strategy in kernels.STRATEGIES:
            _, (labels, classes, log) = merging._image_merge(group, q.COLOURS, q.LEAST, strategy, 35.0)
            changed = sum(classes[labels[y, x]] != before[y, x] for y, x in zip(*np.nonzero(present)))
            row = rows[image, strategy]
            assert (row["regions_before"], row["regions_after"], row["merges"]) == (group["region_id"].nunique(), len(classes), len(log))
            assert row["recolored_pixel_percent"] == pytest.approx(100.0 * changed / present.sum(), abs=1e-6) and row["below_threshold_after"] == sum(np.bincount(labels[present])[1:] < q.LEAST)
    assert len(rows) == 3 * frame["image_id"].nunique()


def test_requests(spark):
    import base64
    import json

    body = {"image": {"name": "a.PNG", "dataUrl": "data:image/png;base64," + base64.b64encode(b"abc").decode()}, "title": "t", "detailZones": [{"mode": "outline", "points": [{"x": 0.1, "y": 0.1}, {"x": 2.0, "y": 0.1}, {"x": 0.5, "y": 0.9}], "radius": 9.0}]}
    rows = spark.createDataFrame([(1, json.dumps(body)), (2, "{}"), (3, json.dumps({"image": {"name": "a.gif", "dataUrl": body["image"]["dataUrl"]}}))], "id int, body string")
    got = {r["id"]: r for r in images.parse_requests(rows, "body").collect()}
    assert bytes(got[1]["image_data"]) == b"abc" and got[1]["error"] is None and got[2]["error"] == "missing image" and got[3]["error"] == "unsupported format"
    parsed = zones.parse_zones(rows, "body").where("id = 1").select("zones").first()["zones"][0]
    assert parsed["radius"] == 0.12 and parsed["points"][1]["x"] == 1.0


def test_polygon_fill(spark):
    square = spark.createDataFrame([([(2.0, 2.0), (8.0, 2.0), (8.0, 6.0), (2.0, 6.0)],)], "points array<struct<x: double, y: double>>")
    assert zones.fill_polygon(square, 20, 20).count() == 24


def test_server(spark):
    import base64
    import json
    import threading
    import urllib.error
    import urllib.request

    from pathlib import Path

    from rasterloom.server import serve
    from rasterloom.session import shared_dir

    image = np.full((60, 80, 3), 235, np.uint8)
    image[15:45, 20:60] = (30, 90, 170)
    url = "data:image/png;base64," + base64.b64encode(sinks.png(image)).decode()
    with serve(spark, port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_port}"
        post = lambda path, body: json.loads(urllib.request.urlopen(urllib.request.Request(at + path, json.dumps(body).encode()), timeout=120).read())
        assert json.loads(urllib.request.urlopen(at + "/health").read()) == {"ok": True}
        made = post("/generate", {"image": {"name": "a.png", "dataUrl": url}, "colors": 3, "detailZones": [{"mode": "brush", "points": [{"x": 0.5, "y": 0.5}], "radius": 0.05}]})
        assert made["ok"] and made["actualColors"] >= 2 and made["pdfDocument"].startswith("data:application/pdf")
        assert made["stats"]["labeling"]["coverage_percent"] == 100.0 and made["detailMaskImage"].startswith("data:image/png") and made["palettePageImage"].startswith("data:image/png")
        found = post("/mask", {"image": {"dataUrl": url}})
        assert found["subject"]["mode"] in ("manual", "global") and found["subjectMaskImage"].startswith("data:image/png") and found["source"] == {"width": 80, "height": 60}
        half = np.zeros((30, 40), np.uint8)
        half[5:25, 8:32] = 255
        split = post("/generate", {"image": {"dataUrl": url}, "colors": 6, "subjectMaskImage": "data:image/png;base64," + base64.b64encode(sinks.png(half)).decode()})
        assert split["maskControlImage"].startswith("data:image/png") and split["stats"]["subject_regions_after"] >= 1
        nothing = "data:image/png;base64," + base64.b64encode(sinks.png(np.zeros((30, 40), np.uint8))).decode()
        for body in ({"image": {"dataUrl": "nothing"}}, {"image": {"dataUrl": url}, "subjectMaskImage": nothing}):
            with pytest.raises(urllib.error.HTTPError):
                post("/generate", body)
        held = Path(shared_dir(spark).removeprefix("file://")) / "rasterloom-scratch"
        before = set(held.iterdir())
        post("/mask", {"image": {"dataUrl": url}, "maxSide": 10**9})
        assert set(held.iterdir()) <= before
        server.shutdown()
