"""Queries without an SQL form against plain searches over their pixels."""

import os
from collections import defaultdict

import numpy as np
import pytest

from rasterloom.plans import catalog
from rasterloom.plans import iterative_queries as q
from rasterloom.plans.common import raster

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CROSS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def pixels(spark, columns, classes=5):
    """Image to place to value."""
    out = defaultdict(dict)
    for r in raster(spark, DATA, classes).select("image_id", "x", "y", *columns).collect():
        out[r["image_id"]][r["x"], r["y"]] = r[columns[0]]
    return out


def flood(places, same):
    """Components of a set of places, by search."""
    left, found = set(places), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            for dx, dy in CROSS:
                at = (x + dx, y + dy)
                if at in left and same((x, y), at):
                    left.remove(at)
                    todo.append(at)
        found.append(part)
    return found


def test_fill_holes(spark):
    got = {(r["image_id"], r["x"], r["y"]): r["filled"] for r in catalog.queries()["fill_holes"](spark, DATA).collect()}
    for image, mask in pixels(spark, ["mask"]).items():
        wide, high = max(x for x, _ in mask) + 1, max(y for _, y in mask) + 1
        clear = {(x, y) for x in range(-1, wide + 1) for y in range(-1, high + 1) if not mask.get((x, y), False)}
        outside = next(part for part in flood(clear, lambda a, b: True) if (-1, -1) in part)
        for at in mask:
            assert got[image, *at] == (at not in outside)
    assert any(got.values()) and not all(got.values())


def test_keep_large_components(spark):
    got = {(r["image_id"], r["x"], r["y"]) for r in catalog.queries()["keep_large_components"](spark, DATA).collect()}
    want = {(image, *at) for image, mask in pixels(spark, ["mask"]).items() for part in flood([at for at, m in mask.items() if m], lambda a, b: True) if len(part) >= 20 for at in part}
    assert got == want and want


def regions(spark):
    """Image to place to (region, class)."""
    out = defaultdict(dict)
    for r in q.labelled(spark, DATA).collect():
        out[r["image_id"]][r["x"], r["y"]] = (r["region_id"], r["p"])
    return out


def test_regions_are_components(spark):
    for places in regions(spark).values():
        want = flood(places, lambda a, b, p=places: p[a][1] == p[b][1])
        got = defaultdict(set)
        for at, (region, _) in places.items():
            got[region].add(at)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def key_of(strategy, difference, shared, source, target):
    if strategy == "balanced":
        return (difference - 8.0 * shared / max(1.0, source**0.5), difference, -shared)
    return (difference, -shared, -target) if strategy == "color" else (-shared, difference, -target)


def test_every_merge_is_the_best_at_its_time(spark):
    """The log replayed on the pixels: always the smallest region too small, into a neighbour that no other beats."""
    log = defaultdict(list)
    for r in catalog.queries()["merge_events"](spark, DATA).collect():
        log[r["image_id"]].append(r)
    merged = {(r["image_id"], r["x"], r["y"]): (r["merged_region"], r["merged_p"]) for r in catalog.queries()["merge_small_regions"](spark, DATA).collect()}
    for image, places in regions(spark).items():
        region, colour = {at: r for at, (r, _) in places.items()}, {r: p for r, p in places.values()}
        for event in sorted(log[image], key=lambda r: r["step"]):
            members, shared = defaultdict(int), defaultdict(lambda: defaultdict(int))
            for (x, y), r in region.items():
                members[r] += 1
                for dx, dy in CROSS:
                    other = region.get((x + dx, y + dy), r)
                    if other != r:
                        shared[r][other] += 1
            source, target = event["source_region"], event["target_region"]
            assert (members[source], source) == min((n, r) for r, n in members.items() if n < q.LEAST and shared[r])
            difference = {r: float(np.linalg.norm(q.COLOURS[colour[source]] - q.COLOURS[colour[r]])) for r in shared[source]}
            keys = {r: key_of("balanced", difference[r], shared[source][r], members[source], members[r]) for r in shared[source]}
            assert keys[target] == min(keys.values())
            assert (event["source_pixels"], event["shared_boundary_pixels"], event["source_palette_index"], event["target_palette_index"]) == (members[source], shared[source][target], colour[source], colour[target])
            assert event["delta_e76"] == pytest.approx(difference[target]) and event["forced_by_tolerance"] == (difference[target] > 35.0)
            region = {at: target if r == source else r for at, r in region.items()}
        left = {r: i for i, r in enumerate(sorted(set(region.values())), 1)}
        assert {at: (left[r], colour[r]) for at, r in region.items()} == {at: merged[image, *at] for at in region}
        assert log[image]


def test_label_places(spark):
    """The innermost pixel nearest to the centroid, by all distances."""
    got = {(r["image_id"], r["region_id"]): r for r in catalog.queries()["label_places"](spark, DATA).collect()}
    for image, places in regions(spark).items():
        wide, high = max(x for x, _ in places) + 1, max(y for _, y in places) + 1
        own = defaultdict(list)
        for at, (region, _) in places.items():
            own[region].append(at)
        for region, members in own.items():
            inside = set(members)
            reach = 1
            while any(all((x + dx, y + dy) in inside for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if dx * dx + dy * dy <= reach * reach) for x, y in members):
                reach += 1
            near = lambda x, y: min(dx * dx + dy * dy for dx in range(-reach - 1, reach + 2) for dy in range(-reach - 1, reach + 2) if (x + dx, y + dy) not in inside)  # noqa: B023, E731
            far = {at: near(*at) ** 0.5 for at in members}
            cx, cy = (sum(m[i] for m in members) / len(members) for i in (0, 1))
            x, y = min((at for at in members if far[at] == max(far.values())), key=lambda at: ((at[0] - cx) ** 2 + (at[1] - cy) ** 2, at[1], at[0]))
            row = got[image, region]
            assert row["distance_px"] == pytest.approx(max(far.values()))
            assert ((row["x_px"] - 0.5 - cx) ** 2 + (row["y_px"] - 0.5 - cy) ** 2) == pytest.approx((x - cx) ** 2 + (y - cy) ** 2, abs=1e-9)
        assert (wide, high) <= (100, 100)


def test_lloyd_rounds_lower_the_cost(spark):
    """The fitted centres are means of their nearest colours, or close to it, and no worse than the first ones."""
    from rasterloom.functions import color
    from pyspark.sql import functions as F

    rgb = color.key_rgb(F.col("p_partkey"))
    points = np.array([r["v"] for r in spark.read.parquet(f"{DATA}/part.parquet").select(F.array(*color.rgb_to_lab(*rgb)).alias("v")).collect()])
    centres = np.array([r["c"] for r in catalog.queries()["kmeans_fit"](spark, DATA).collect()])
    cost = lambda c: ((points[:, None] - c[None]) ** 2).sum(-1).min(1).sum()
    assert centres.shape == (8, 3) and cost(centres) < 0.6 * cost(points[:8])
