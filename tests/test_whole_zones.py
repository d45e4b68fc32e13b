"""Every embedding's zone is rasterised, against brute force."""

import os

import numpy as np

from rasterloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_pages_hold_the_zones_of_all_embeddings(spark):
    got = {(r["page"], r["x"], r["y"]) for r in catalog.queries()["zone_raster"](spark, DATA).collect()}
    x, y = np.meshgrid(np.arange(100) + 0.5, np.arange(100) + 0.5)
    want = set()
    for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect():
        ax, ay, bx, by = (50 + 200 * float(v) for v in r["embedding"][:4])
        dx, dy = (bx - ax, by - ay) if r["vec_id"] % 2 else (0.0, 0.0)
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / max(1e-9, dx * dx + dy * dy), 0, 1)
        rows, columns = np.nonzero((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2 <= 16)
        want |= {(r["vec_id"] // 64, int(c), int(w)) for c, w in zip(columns, rows)}
    assert got == want and len({page for page, *_ in got}) > 1
