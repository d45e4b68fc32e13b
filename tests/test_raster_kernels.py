"""Array kernels against literal cases and brute force."""

from dataclasses import fields, replace

import numpy as np
import pytest

from rasterloom.operators import kernels as k
from rasterloom.plans.config import Config
from rasterloom.plans.sheets import lab_hex, lab_image, make_sheet
from rasterloom.sources import sinks


def test_adjacency_of_a_literal_image():
    labels = np.array([[1, 1, 2], [1, 3, 2], [3, 3, 2]])
    assert k.shared_sides(labels) == [(1, 2, 1), (1, 3, 3), (2, 3, 2)]


def test_components_of_a_literal_image():
    classes = np.array([[0, 0, 1], [0, 1, 1], [1, 1, 0]])
    ids = k.label_components(classes, np.ones((3, 3), bool), 4)
    assert ids.max() == 3 and ids[0, 0] == 1 and ids[2, 2] == 2 and np.bincount(ids.ravel())[1:].sum() == 9
    assert k.label_components(classes, np.ones((3, 3), bool), 8).max() == 3
    assert k.label_components(np.eye(3, dtype=int), np.ones((3, 3), bool), 8).max() == 2


def test_distance_against_brute_force():
    rng = np.random.default_rng(1)
    labels = np.kron(rng.integers(0, 3, (5, 6)), np.ones((4, 4), int))
    framed = np.pad(labels, 1, constant_values=-1)
    yy, xx = np.mgrid[: framed.shape[0], : framed.shape[1]]
    far = k.distance_to_outside(labels)
    for y, x in np.ndindex(labels.shape):
        other = framed != labels[y, x]
        assert np.isclose(far[y, x], np.sqrt(((yy - y - 1) ** 2 + (xx - x - 1) ** 2)[other].min()))


def test_island_merges():
    labels = np.ones((7, 7), int)
    labels[3, 3] = 2
    merged, classes, log = k.merge_image(labels, {1: 0, 2: 1}, {1: 4, 2: 4}, np.array([[0.0, 0, 0], [50.0, 0, 0]]), "balanced", 35.0)
    assert merged.max() == 1 and classes == {1: 0} and len(log) == 1 and log[0].source_region == 2 and log[0].forced_by_tolerance


def test_strategies_choose_differently():
    labels = np.array([[1, 1, 1], [1, 2, 3], [1, 1, 3]])
    colours = np.array([[0.0, 0, 0], [50.0, 0, 0], [52.0, 0, 0]])
    target = {s: k.merge_image(labels, {1: 0, 2: 1, 3: 2}, {1: 1, 2: 2, 3: 1}, colours, s, 35.0)[2][0].target_region for s in ("color", "boundary")}
    assert target == {"color": 3, "boundary": 1}


@pytest.mark.parametrize("strategy", list(k.STRATEGIES))
def test_merging_keeps_pixels_and_counts(strategy):
    rng = np.random.default_rng(2)
    classes = rng.integers(0, 3, (30, 40))
    ids = k.label_components(classes, np.ones(classes.shape, bool), 8)
    of = {i: int(classes[ids == i][0]) for i in range(1, ids.max() + 1)}
    merged, left, log = k.merge_image(ids, of, dict.fromkeys(of, 9), rng.normal(size=(3, 3)) * 30, strategy, 20.0)
    assert len(of) - len(log) == merged.max() == len(left) and [m.step for m in log] == list(range(1, len(log) + 1))
    assert (np.bincount(merged.ravel())[1:] >= 9).all()


def test_palette_clean_up():
    colours = np.array([[20.0, 0, 0], [21.0, 0.5, 0], [80.0, 10, 10]])
    cleaned, new = k.clean_palette(colours, np.array([5, 1, 5]), 3.0, 2)
    assert len(cleaned) == 2 and new[0] == new[1] != new[2]
    assert len(k.clean_palette(colours, np.array([5, 1, 5]), 3.0, 3)[0]) == 3


def test_published_colour_differences():
    pairs = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644)]
    for one, two, want in pairs:
        assert abs(k.delta_e2000(np.array(one), np.array(two)) - want) < 1e-4


def test_lab_round_trip():
    for rgb in ((0, 0, 0), (255, 255, 255), (12, 200, 99), (250, 3, 128)):
        assert lab_hex(lab_image(np.array([[rgb]], float))[0, 0]) == "#%02X%02X%02X" % rgb


def test_masks():
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert k.fill_holes(ring)[4, 4] and not k.fill_holes(ring)[0, 0]
    speck = np.zeros((30, 30), bool)
    speck[3:12, 3:12] = True
    speck[25, 25] = True
    assert not k.clean_mask(speck)[25, 25] and k.clean_mask(speck)[6, 6]


def test_every_boundary_edge_is_traced_once():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, (12, 9))
    edges = k.boundary_edges(labels)
    walked = [frozenset(e) for line in k.trace(edges) for e in zip(line, line[1:])]
    assert len(walked) == len(set(walked)) == len(edges) and set(walked) == set(map(frozenset, edges))


def test_contours_enclose_the_mask():
    mask = np.zeros((10, 12), bool)
    mask[2:8, 3:9] = True
    mask[4:6, 5:7] = False
    loops = k.mask_contours(mask)
    area = lambda q: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, q[1:] + q[:1]))) / 2
    assert len(loops) == 2 and all(q[0] == q[-1] for q in loops)
    assert sorted(round(area(q)) for q in loops) == [4, 36] or sorted(area(q) for q in loops)[1] > 30


def test_simplify_keeps_ends_and_corners():
    line = [(float(x), 0.0) for x in range(6)] + [(5.0, float(y)) for y in range(1, 5)]
    assert k.simplify(line, 0.1) == [(0.0, 0.0), (5.0, 0.0), (5.0, 4.0)]


def test_thinning_leaves_lines_one_pixel_wide():
    bar = np.zeros((15, 40), bool)
    bar[5:10, 4:36] = True
    thin = k.thin(bar)
    assert thin.any() and thin.sum(axis=0).max() <= 2 and (thin & ~bar).sum() == 0


def test_superpixels_cover_the_image():
    rng = np.random.default_rng(4)
    lab = rng.normal(size=(40, 50, 3)) * 5
    for adaptive in (False, True):
        labels = k.slic(lab, 30, 10.0, adaptive=adaptive)
        assert labels.min() >= 0 and 10 <= len(np.unique(labels)) <= 60


def test_a_sheet_from_two_halves():
    rgb = np.zeros((64, 80, 3))
    rgb[:, :40] = (220, 40, 40)
    rgb[:, 40:] = (40, 60, 220)
    rgb[10, 10] = (40, 60, 220)
    sheet = make_sheet(rgb, Config(colors=2, segmentation="components", smoothing_radius=0))
    assert len(sheet["regions"]) == 2 and sum(r["pixel_count"] for r in sheet["regions"]) == 64 * 80 and sheet["svg"].startswith("<svg")
    assert len(sheet["regions_before"]) - len(sheet["merges"]) == len(sheet["regions"])
    assert [(e["region_a"], e["region_b"], e["boundary_pixels"]) for e in sheet["adjacency"]] == [(1, 2, 64)] and len(sheet["labels"]) == 2 and all(r["is_thin"] is False for r in sheet["regions"])
    subject = np.zeros((64, 80), bool)
    subject[:, :40] = True
    split = make_sheet(rgb, Config(colors=8, superpixels=60, subject_mode="manual"), subject)
    assert len(split["palette"]) >= 2 and any(r["is_subject"] for r in split["regions"]) and "subject_overlay" in split["images"]
    assert "subject_overlay" not in make_sheet(rgb, Config(colors=8, superpixels=60), subject)["images"]


def test_every_parameter_has_its_effect():
    """A change of each parameter changes something of a noisy picture's sheet."""
    rng = np.random.default_rng(1)
    yy, xx = np.mgrid[:60, :80]
    rgb = np.clip(np.stack([120 + 100 * np.sin(xx / 9), 90 + 90 * np.cos(yy / 7), 60 + 2 * xx], -1) + rng.normal(0, 14, (60, 80, 3)), 0, 255)
    rgb[8:30:4, 4:20] *= 0.35
    subject, detail = (xx - 40) ** 2 + (yy - 30) ** 2 < 300, (xx > 60) & (yy > 40)
    bases = [
        Config(colors=12, superpixels=600, smoothing_radius=0, background_smoothing_radius=0, background_superpixel_ratio=0.9, subject_mode="manual", min_region_area_mm2=60.0, background_min_region_area_mm2=60.0, subject_min_region_area_mm2=60.0, detail_min_region_area_mm2=30.0, sample_pixels=2000),
        Config(colors=8, segmentation="components", smoothing_radius=0, background_smoothing_radius=0, subject_mode="manual", subject_min_region_area_mm2=300.0, background_min_region_area_mm2=300.0, detail_min_region_area_mm2=20.0, number_padding_mm=5.0, sample_pixels=2000),
        Config(colors=4, superpixels=12, segmentation="components", subject_mode="manual", smoothing_radius=3, background_smoothing_radius=3, min_region_area_mm2=400.0, sample_pixels=2000),
    ]
    key = lambda c: repr({n: (v.tolist() if hasattr(v, "tolist") else v) for n, v in make_sheet(rgb, c, subject, detail).items()})
    first = [key(base) for base in bases]
    changed = {
        "auto_tune": True, "preprocess_sigma_color": 0.2, "preprocess_sigma_spatial": 9.0, "colors": 5, "sample_pixels": 60, "seed": 7, "palette_merge_delta_e": 19.0, "segmentation": "slic_legacy", "superpixels": 40, "compactness": 60.0, "smoothing_radius": 2, "connectivity": 4,
        "subject_mode": "none", "subject_color_ratio": 0.5, "background_superpixel_ratio": 1.0, "background_smoothing_radius": 5, "subject_min_region_area_mm2": 400.0, "background_min_region_area_mm2": 900.0, "detail_min_region_area_mm2": 0.1, "min_region_area_mm2": 300.0,
        "thin_width_mm": 60.0, "thin_merge_passes": 0, "merge_strategy": "boundary", "color_tolerance": 0.5, "title": "other", "page_format": "a3", "orientation": "landscape", "margin_mm": 30.0, "palette_layout": "separate", "legend_height_mm": 90.0, "number_font_mm": 9.0, "min_number_font_mm": 0.5,
        "number_padding_mm": 4.0, "line_width_mm": 0.4, "contour_smoothing_iterations": 4, "min_contour_smooth_area_px": 5000.0, "contour_simplify_mm": 1.0, "line_art_enabled": False, "line_art_detail": 0.0,
    }
    assert set(changed) | {"max_side", "mask_threshold"} == {f.name for f in fields(Config)}
    idle = [name for name, value in changed.items() if all(key(replace(base, **{name: value})) == own for base, own in zip(bases, first))]
    # strokes show where colours differ too little for regions of their own
    flat = np.full((60, 80, 3), 200.0)
    flat[:, 60:], flat[10:50:12, 8:44] = 20.0, 60.0
    drawn = lambda **own: make_sheet(flat, Config(colors=2, segmentation="components", **own))["line_art_pixels"]
    assert drawn() > 0 == drawn(line_art_enabled=False) and drawn() != drawn(line_art_detail=0.0)
    # merges have a choice where many small regions meet
    tiles = np.kron(rng.integers(0, 6, (15, 20)), np.ones((4, 4), int))
    patched = np.array([[20, 20, 20], [200, 60, 40], [60, 160, 80], [240, 230, 120], [90, 90, 220], [250, 250, 250]], float)[tiles]
    merges = lambda **own: make_sheet(patched, replace(Config(colors=6, segmentation="components", smoothing_radius=0, min_region_area_mm2=200.0, number_padding_mm=5.0), **own))["merges"]
    assert len({repr(merges(merge_strategy=name)) for name in k.STRATEGIES}) == 3 and len(merges(thin_merge_passes=0)) < len(merges())
    assert set(idle) <= {"line_art_enabled", "line_art_detail", "merge_strategy", "thin_merge_passes"}, ",".join(idle)


def test_mask_overlay_marks_the_border():
    rgb, mask = np.full((5, 5, 3), 100), np.zeros((5, 5), bool)
    mask[1:4, 1:4] = True
    out = k.mask_overlay(rgb, mask)
    assert out[2, 2].tolist() == [100, 100, 100] and out[1, 1].tolist() == [255, 40, 80] and out[0, 0].tolist() == [74, 157, 165]


def test_configuration_ranges():
    assert Config().problems() == []
    assert Config(colors=1).problems() == ["colors"] and Config(merge_strategy="x").problems() == ["merge_strategy"]
    assert Config(colors=3, subject_mode="manual").problems() == ["colors"]
    with pytest.raises(ValueError):
        Config(max_side=1).checked()
    assert Config(colors=8).split_colors() == (5, 3) and Config(colors=4).split_colors() == (2, 2)


def test_png_and_pdf_are_well_formed():
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    assert sinks.png(image)[:8] == b"\x89PNG\r\n\x1a\n" and sinks.pdf([image, image], 210, 297).count(b"/Type /Page ") == 2
