"""Array kernels for one image at a time; they run inside grouped maps over images."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np

Point = tuple[float, float]


# --- components and distances ---------------------------------------------------------------------------------------


def label_components(classes: np.ndarray, present: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Components of equal class, numbered from 1 by class, then by first pixel; absent pixels get 0."""
    height, width = classes.shape
    number = np.arange(height * width).reshape(height, width)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    left, right = [], []
    for dy, dx in steps:
        a = (slice(0, height - dy), slice(max(0, -dx), width - max(0, dx)))
        b = (slice(dy, height), slice(max(0, dx), width + min(0, dx)))
        same = (classes[a] == classes[b]) & present[a] & present[b]
        left.append(number[a][same])
        right.append(number[b][same])
    a, b = np.concatenate(left), np.concatenate(right)
    root = number.ravel().copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    heads = np.flatnonzero((root == number.ravel()) & present.ravel())
    order = heads[np.lexsort((heads, classes.ravel()[heads]))]
    ids = np.zeros(height * width, np.int64)
    ids[order] = np.arange(1, len(order) + 1)
    return np.where(present, ids[root].reshape(height, width), 0)


def _steps_to_edge(labels: np.ndarray) -> np.ndarray:
    """Steps along a column to the nearest pixel of another label, or outside."""
    height = len(labels)
    up, down = np.ones(labels.shape, np.int32), np.ones(labels.shape, np.int32)
    for y in range(1, height):
        up[y] = np.where(labels[y] == labels[y - 1], up[y - 1] + 1, 1)
    for y in range(height - 2, -1, -1):
        down[y] = np.where(labels[y] == labels[y + 1], down[y + 1] + 1, 1)
    return np.minimum(up, down)


def distance_to_outside(labels: np.ndarray, rows: int = 64) -> np.ndarray:
    """Each pixel's exact distance to the nearest pixel of another label; outside the image counts as another label.

    Squared steps along the column are carried along the row.  Behind a row's next edge they say too much, which no minimum takes.  A few rows at a time stay in the processor's cache.
    """
    column = _steps_to_edge(labels) ** 2
    best = np.minimum(column, _steps_to_edge(np.ascontiguousarray(labels.T)).T ** 2)
    for y in range(0, len(labels), rows):
        here, heights = best[y : y + rows], column[y : y + rows]
        for k in range(1, labels.shape[1]):
            if k * k >= here.max():
                break
            raised = heights + k * k
            np.minimum(here[:, k:], raised[:, :-k], out=here[:, k:])
            np.minimum(here[:, :-k], raised[:, k:], out=here[:, :-k])
    return np.sqrt(best.astype(float))


def row_envelopes(steps: np.ndarray) -> np.ndarray:
    """For each place of each row the least ``(x - q) ** 2 + steps[q] ** 2`` over all places q of the row: the lower envelope of its parabolas, in whole numbers.

    One pass finds, for all rows in step, the parabolas of the envelope and where each begins.
    """
    rows, width = steps.shape
    value = steps.astype(np.int64) ** 2
    raised = value + np.arange(width) ** 2
    site, begin, top = np.zeros((rows, width), np.int64), np.zeros((rows, width), np.int64), np.zeros(rows, np.int64)
    every = np.arange(rows)
    for q in range(1, width):
        rest, start = every, np.empty(rows, np.int64)
        while len(rest):
            last = site[rest, top[rest]]
            start[rest] = (raised[rest, q] - raised[rest, last]) // (2 * (q - last)) + 1
            # a parabola that the new one undercuts from its beginning on leaves the envelope
            under = start[rest] <= begin[rest, top[rest]]
            bottom = under & (top[rest] == 0)
            start[rest[bottom]] = 0
            top[rest[under]] -= 1
            rest = rest[under & ~bottom]
        top += 1
        site[every, top], begin[every, top] = q, start
    number = np.zeros((rows, width), np.int64)
    order = np.arange(width)
    used = (order <= top[:, None]) & (begin < width)
    r, k = np.nonzero(used)
    number[r, begin[r, k]] = k
    at = np.take_along_axis(site, np.maximum.accumulate(number, axis=1), 1)
    return (order - at) ** 2 + np.take_along_axis(value, at, 1)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Set what the mask encloses: background components that do not touch the border."""
    padded = np.pad(mask, 1)
    ids = label_components(padded.astype(np.int8), np.ones(padded.shape, bool), 4)
    return ((ids != ids[0, 0]) | padded)[1:-1, 1:-1]


def keep_large(mask: np.ndarray, least: int, connectivity: int = 4) -> np.ndarray:
    ids = label_components(mask.astype(np.int8), mask, connectivity)
    return (np.bincount(ids.ravel())[ids] >= least) & mask


def shift_or(mask: np.ndarray, steps: Iterable[tuple[int, int]]) -> np.ndarray:
    out, padded = mask.copy(), np.pad(mask, 2)
    for dy, dx in steps:
        out |= padded[2 + dy : 2 + dy + mask.shape[0], 2 + dx : 2 + dx + mask.shape[1]]
    return out


def disk_steps(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def close_square(mask: np.ndarray, times: int = 2) -> np.ndarray:
    """Closings with a 3 x 3 square one after the other; outside is unset, which also unsets the border."""
    square = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    out = mask
    for _ in range(times):
        out = ~shift_or(~np.pad(shift_or(out, square), 1), square)[1:-1, 1:-1]
    return out


def clean_mask(mask: np.ndarray) -> np.ndarray:
    """Close, fill holes, drop small components unless there are no others."""
    out = fill_holes(close_square(mask))
    large = keep_large(out, max(16, int(out.size * 0.0001)))
    return large if large.any() else out


# --- merging --------------------------------------------------------------------------------------------------------


class Merge(NamedTuple):
    step: int
    source_region: int
    target_region: int
    source_palette_index: int
    target_palette_index: int
    source_pixels: int
    shared_boundary_pixels: int
    delta_e76: float
    forced_by_tolerance: bool


#: Order of candidates by strategy, from (difference, shared boundary, source size, target size); the smallest wins.
STRATEGIES: dict[str, Callable[[float, int, int, int], tuple]] = {
    "color": lambda difference, shared, source, target: (difference, -shared, -target),
    "boundary": lambda difference, shared, source, target: (-shared, difference, -target),
    "balanced": lambda difference, shared, source, target: (difference - 8.0 * shared / max(1.0, source**0.5), difference, -shared),
}


class RegionGraph:
    """Regions with sizes, classes, least sizes and groups, and the boundaries that they share."""

    def __init__(self, sizes: dict[int, int], classes: dict[int, int], least: dict[int, int], edges: Iterable[tuple[int, int, int]], groups: dict[int, int] | None = None):
        self.sizes, self.classes, self.least = dict(sizes), dict(classes), dict(least)
        self.groups = groups or {}
        self.shared: dict[int, dict[int, int]] = {r: {} for r in sizes}
        for a, b, n in edges:
            self.shared[a][b] = n
            self.shared[b][a] = n
        self.into: dict[int, int] = {}

    def choose(self, region: int, colours: np.ndarray, strategy: str) -> tuple[int, float] | None:
        """The neighbour to merge into, of the own group where there is one, and the colour difference."""
        near = list(self.shared[region])
        own = [r for r in near if self.groups.get(r, 0) == self.groups.get(region, 0)]
        best = None
        for r in own or near:
            difference = float(np.linalg.norm(colours[self.classes[region]] - colours[self.classes[r]]))
            key = STRATEGIES[strategy](difference, self.shared[region][r], self.sizes[region], self.sizes[r])
            if best is None or key < best[0]:
                best = (key, r, difference)
        return best and best[1:]

    def absorb(self, source: int, target: int) -> None:
        for r, n in self.shared.pop(source).items():
            del self.shared[r][source]
            if r != target:
                total = self.shared[target].get(r, 0) + n
                self.shared[target][r] = self.shared[r][target] = total
        self.sizes[target] += self.sizes.pop(source)
        self.least[target] = max(self.least[target], self.least[source])
        self.into[source] = target

    def merge_small(self, colours: np.ndarray, strategy: str, tolerance: float) -> list[Merge]:
        """Merge regions below their least size, smallest first, until none is left that has a neighbour."""
        waiting = [(n, r) for r, n in self.sizes.items() if n < self.least[r]]
        heapq.heapify(waiting)
        log: list[Merge] = []
        while waiting:
            size, region = heapq.heappop(waiting)
            if self.sizes.get(region) != size or size >= self.least[region]:
                continue
            found = self.choose(region, colours, strategy)
            if found is None:
                continue
            target, difference = found
            log.append(Merge(len(log) + 1, region, target, self.classes[region], self.classes[target], size, self.shared[region][target], difference, difference > tolerance))
            self.absorb(region, target)
            if self.sizes[target] < self.least[target]:
                heapq.heappush(waiting, (self.sizes[target], target))
        return log

    def renumbered(self) -> dict[int, int]:
        """Every region's number after the merges: survivors by ascending old number, from 1."""
        final = {r: i for i, r in enumerate(sorted(self.sizes), 1)}
        out = {}
        for r in [*self.sizes, *self.into]:
            at = r
            while at in self.into:
                at = self.into[at]
            out[r] = final[at]
        return out


def shared_sides(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(a, b, sides) of neighbouring labels a < b, label 0 left out, in ascending order."""
    pairs = np.concatenate([np.stack([labels[:, :-1].ravel(), labels[:, 1:].ravel()], 1), np.stack([labels[:-1].ravel(), labels[1:].ravel()], 1)])
    pairs = np.sort(pairs[(pairs[:, 0] != pairs[:, 1]) & (pairs > 0).all(axis=1)], axis=1)
    edges, counts = np.unique(pairs, axis=0, return_counts=True)
    return [(int(a), int(b), int(n)) for (a, b), n in zip(edges, counts)]


def merge_image(labels: np.ndarray, classes: dict[int, int], least: dict[int, int], colours: np.ndarray, strategy: str, tolerance: float, groups: dict[int, int] | None = None) -> tuple[np.ndarray, dict[int, int], list[Merge]]:
    """Merge an image's small regions; returns labels, their classes and the log."""
    ids, counts = np.unique(labels[labels > 0], return_counts=True)
    graph = RegionGraph(dict(zip(ids.tolist(), counts.tolist())), classes, least, shared_sides(labels), groups)
    log = graph.merge_small(colours, strategy, tolerance)
    number = graph.renumbered()
    table = np.zeros(int(labels.max(initial=0)) + 1, np.int64)
    for old, new in number.items():
        table[old] = new
    return table[labels], {number[r]: classes[r] for r in graph.sizes}, log


def label_width_mm(number: int, least_font: float, padding: float) -> float:
    return least_font * max(1.0, 0.62 * len(str(number))) + 2.0 * padding


def improve_labels(labels: np.ndarray, classes: dict[int, int], colours: np.ndarray, scale: float, least_pixels: int, least_area: float, least_font: float, padding: float, strategy: str, tolerance: float, groups_of: Callable[[np.ndarray], dict[int, int]] | None = None, passes: int = 2) -> tuple[np.ndarray, dict[int, int], list[Merge]]:
    """Merge regions too narrow for their number, or ragged and small, in up to ``passes`` rounds."""
    log: list[Merge] = []
    for _ in range(passes):
        far = distance_to_outside(labels)
        count = np.bincount(labels.ravel())
        reach = np.zeros(len(count))
        np.maximum.at(reach, labels.ravel(), far.ravel())
        border = np.bincount(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]), minlength=len(count)).astype(float)
        for a, b, n in shared_sides(labels):
            border[a] += n
            border[b] += n
        least, tight = {}, 0
        for r in range(1, len(count)):
            compact = 4 * math.pi * count[r] / max(1.0, border[r]) ** 2
            narrow = 2 * reach[r] * scale + 1e-9 < label_width_mm(classes[r] + 1, least_font, padding)
            ragged = compact < 0.018 and count[r] * scale**2 < max(4.0 * least_area, 28.0)
            tight += narrow or ragged
            least[r] = max(least_pixels, int(count[r]) + 1) if narrow or ragged else least_pixels
        if not tight:
            break
        labels, classes, new = merge_image(labels, classes, least, colours, strategy, tolerance, groups_of(labels) if groups_of else None)
        if not new:
            break
        log.extend(m._replace(step=len(log) + i) for i, m in enumerate(new, 1))
    return labels, classes, log


# --- palettes -------------------------------------------------------------------------------------------------------


def delta_e2000(one: np.ndarray, two: np.ndarray) -> float:
    """The published CIEDE2000 difference of two colours."""
    (l1, a1, b1), (l2, a2, b2) = map(tuple, (np.asarray(one, float), np.asarray(two, float)))
    mean = ((a1 * a1 + b1 * b1) ** 0.5 + (a2 * a2 + b2 * b2) ** 0.5) / 2
    lift = 1 + 0.5 * (1 - math.sqrt(mean**7 / (mean**7 + 25.0**7)))
    p, q = complex(a1 * lift, b1), complex(a2 * lift, b2)
    c1, c2 = abs(p), abs(q)
    h1, h2 = (math.degrees(math.atan2(z.imag, z.real)) % 360 if z else 0.0 for z in (p, q))
    turn, total = (0.0, h1 + h2) if c1 * c2 == 0 else ((h2 - h1 + 180) % 360 - 180, None)
    if total is None:
        if h2 - h1 == 180:
            turn = 180.0
        total = (h1 + h2) / 2 if abs(h1 - h2) <= 180 else ((h1 + h2 + 360) / 2 if h1 + h2 < 360 else (h1 + h2 - 360) / 2)
    height = 2 * math.sqrt(c1 * c2) * math.sin(math.radians(turn / 2))
    chroma, light = (c1 + c2) / 2, (l1 + l2) / 2
    wave = lambda k, s: math.cos(math.radians(k * total + s))
    t = 1 - 0.17 * wave(1, -30) + 0.24 * wave(2, 0) + 0.32 * wave(3, 6) - 0.2 * wave(4, -63)
    sl, sc, sh = 1 + 0.015 * (light - 50) ** 2 / math.sqrt(20 + (light - 50) ** 2), 1 + 0.045 * chroma, 1 + 0.015 * chroma * t
    rotation = -math.sin(math.radians(60 * math.exp(-(((total - 275) / 25) ** 2)))) * 2 * math.sqrt(chroma**7 / (chroma**7 + 25.0**7))
    dl, dc, dh = (l2 - l1) / sl, (c2 - c1) / sc, height / sh
    return math.sqrt(max(0.0, dl * dl + dc * dc + dh * dh + rotation * dc * dh))


def clean_palette(colours: np.ndarray, counts: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Join near colours: each, by falling count, to the nearest leading one within the threshold once ``least`` lead; then the
    closest groups by weighted mean. Returns the colours ordered by lightness, a and b, and each old colour's new index."""
    k = len(colours)
    if k <= least or threshold <= 0:
        return colours, np.arange(k)
    weight = np.maximum(1, counts).astype(float)
    groups: list[list[int]] = []
    for colour in sorted(range(k), key=lambda c: (-counts[c], c)):
        distance = [delta_e2000(colours[colour], colours[g[0]]) for g in groups]
        if len(groups) >= least and distance and min(distance) < threshold:
            groups[distance.index(min(distance))].append(colour)
        else:
            groups.append([colour])
    mean = lambda g: np.average(colours[g], axis=0, weights=weight[g])
    while len(groups) > least:
        centres = [mean(g) for g in groups]
        pairs = [(delta_e2000(centres[i], centres[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
        nearest = min(pairs, default=(threshold, 0, 0))
        if nearest[0] >= threshold:
            break
        groups[nearest[1]] += groups.pop(nearest[2])
    centres = np.array([mean(g) for g in groups])
    order = np.lexsort(centres.T[::-1])
    rank = np.argsort(order)
    new = np.empty(k, int)
    for i, g in enumerate(groups):
        new[g] = rank[i]
    return centres[order], new


def mask_overlay(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The image with everything outside the mask tinted and the mask's inner border marked."""
    tint, share, border = np.array([50.0, 210.0, 225.0]), 0.52, np.array([255.0, 40.0, 80.0])
    padded = np.pad(mask, 1)
    inner = padded[1:-1, 1:-1] & padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    out = np.where(mask[..., None], rgb, rgb * (1 - share) + tint * share)
    return np.clip(np.rint(np.where((mask & ~inner)[..., None], border, out)), 0, 255).astype(np.uint8)


def cut_corners(line: list[Point], rounds: int, closed: bool) -> list[Point]:
    """Chaikin's corner cutting; open lines keep their ends, closed ones end where they begin."""
    points = np.array(line, float)
    for _ in range(rounds):
        p, q = points[:-1], points[1:]
        cut = np.stack([0.75 * p + 0.25 * q, 0.25 * p + 0.75 * q], 1).reshape(-1, 2)
        points = np.vstack([cut, cut[:1]]) if closed else np.vstack([points[:1], cut, points[-1:]])
    return [tuple(p) for p in points.tolist()]


# --- filters and strokes --------------------------------------------------------------------------------------------


def gaussian(image: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(image, pad, mode="symmetric")
        image = sum(w * np.take(padded, np.arange(k, k + image.shape[axis]), axis) for k, w in enumerate(weights))
    return image


def bilateral(image: np.ndarray, sigma_value: float, sigma_space: float) -> np.ndarray:
    """Average over the window, weighted by distance and by likeness over all channels."""
    flat = image.ndim == 2
    image = (image[..., None] if flat else image).astype(np.float32)
    radius = max(1, int(math.ceil(3 * sigma_space)) // 2)
    height, width = image.shape[:2]
    channels = [np.ascontiguousarray(c) for c in np.moveaxis(image, -1, 0)]
    padded = [np.pad(c, radius, mode="edge") for c in channels]
    total, weight = [np.zeros((height, width), np.float32) for _ in channels], np.zeros((height, width), np.float32)
    scale = np.float32(-0.5 / sigma_value**2)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            near = [p[radius + dy : radius + dy + height, radius + dx : radius + dx + width] for p in padded]
            w = np.square(near[0] - channels[0])
            for n, c in zip(near[1:], channels[1:]):
                w += np.square(n - c)
            w *= scale
            w += np.float32(-0.5 * (dy * dy + dx * dx) / sigma_space**2)
            np.exp(w, out=w)
            for t, n in zip(total, near):
                t += w * n
            weight += w
    out = np.stack([t / weight for t in total], -1).astype(float)
    return out[..., 0] if flat else out


def crests(image: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the softened image's gradient is greatest across itself, and its size; the image's border is not taken out."""
    soft = np.pad(gaussian(image, sigma), 1, mode="edge")
    diff, mean = lambda a, b: a - b, lambda a, b, c: (a + 2 * b + c) / 4
    rows = mean(soft[:-2], soft[1:-1], soft[2:])
    gx = diff(rows[:, 2:], rows[:, :-2])
    columns = mean(soft[:, :-2], soft[:, 1:-1], soft[:, 2:])
    gy = diff(columns[2:], columns[:-2])
    size = np.hypot(gx, gy)
    padded = np.pad(size, 1)
    at = lambda dy, dx: padded[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    sector = np.round(np.arctan2(gy, gx) / (math.pi / 4)).astype(int) % 4
    crest = np.zeros(size.shape, bool)
    for s, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        crest |= (sector == s) & (size >= at(dy, dx)) & (size >= at(-dy, -dx))
    return crest, size


def canny(image: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    """Edges: Gaussian, Sobel, thinning across the gradient, hysteresis over eight neighbours."""
    crest, size = crests(image, sigma)
    crest[[0, -1]] = False
    crest[:, [0, -1]] = False
    weak = crest & (size >= low)
    ids = label_components(weak.astype(np.int8), weak, 8)
    return weak & np.isin(ids, np.unique(ids[crest & (size >= high)]))


def thin_rounds(mask: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``rounds`` rounds of thinning by the two-pass rule on the eight neighbours: what is left and what has gone."""
    out = np.pad(mask, 1).astype(np.int8)
    for _ in range(rounds):
        changed = False
        for half in (0, 1):
            n = [np.roll(out, (-dy, -dx), (0, 1)) for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            around, turns = sum(n), sum((n[i] == 0) & (n[(i + 1) % 8] == 1) for i in range(8))
            first, second = (n[0] * n[2] * n[4], n[2] * n[4] * n[6]) if half == 0 else (n[0] * n[2] * n[6], n[0] * n[4] * n[6])
            drop = (out == 1) & (around >= 2) & (around <= 6) & (turns == 1) & (first == 0) & (second == 0)
            changed |= bool(drop.any())
            out[drop] = 0
        if not changed:
            break
    kept = out[1:-1, 1:-1].astype(bool)
    return kept, mask & ~kept


def thin(mask: np.ndarray) -> np.ndarray:
    """Thin to a skeleton."""
    while True:
        mask, gone = thin_rounds(mask, 64)
        if not gone.any():
            return mask


def line_art(gray: np.ndarray, subject: np.ndarray | None, detail: np.ndarray | None, labels: np.ndarray | None, strength: float) -> np.ndarray:
    """Inner strokes: coarse edges, fine ones where wanted, none along region boundaries, thinned."""
    soft = bilateral(gray, 0.045, 2.0)
    fine, coarse = canny(soft, 1.05, 0.045, 0.16), canny(soft, 2.15, 0.035, 0.13)
    if subject is not None:
        strokes = coarse | fine & shift_or(subject, disk_steps(1))
    else:
        strokes = coarse | fine if strength >= 0.55 else coarse
    if detail is not None:
        strokes = strokes | fine & shift_or(detail, disk_steps(2))
    if labels is not None:
        strokes = strokes & ~shift_or(boundary(labels), disk_steps(1))
    return thin(keep_large(strokes, max(7, round(strokes.size / 180_000)), 8))


def boundary(labels: np.ndarray) -> np.ndarray:
    out = np.zeros(labels.shape, bool)
    for a, b in (((slice(None), slice(0, -1)), (slice(None), slice(1, None))), ((slice(0, -1),), (slice(1, None),))):
        differs = labels[a] != labels[b]
        out[a] |= differs
        out[b] |= differs
    return out


# --- tracing --------------------------------------------------------------------------------------------------------


def trace(edges: Iterable[tuple[tuple, tuple]]) -> list[list[tuple]]:
    """Cover a graph's edges with paths that end where the degree is not two; then the cycles that are left.

    Paths start at the smallest such node and go to the smallest unused neighbour; cycles start at the smallest unused edge.
    """
    near: dict[tuple, set[tuple]] = defaultdict(set)
    unused = set()
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
        unused.add((min(a, b), max(a, b)))

    def follow(path: list[tuple]) -> list[tuple]:
        while True:
            a, b = path[-2:]
            unused.discard((min(a, b), max(a, b)))
            ahead = [c for c in near[b] if c != a and (min(b, c), max(b, c)) in unused]
            if b == path[0] or not ahead or len(near[b]) != 2:
                return path
            path.append(min(ahead))

    paths = [follow([node, other]) for node in sorted(n for n in near if len(near[n]) != 2) for other in sorted(near[node]) if (min(node, other), max(node, other)) in unused]
    for edge in sorted(unused):
        if edge in unused:
            paths.append(follow(list(edge)))
    return paths


def skeleton_paths(mask: np.ndarray) -> list[list[Point]]:
    """A skeleton's strokes of at least three pixels, as pixel centres (x, y)."""
    pixels = set(map(tuple, np.argwhere(mask).tolist()))
    edges = [((y, x), (y + dy, x + dx)) for y, x in pixels for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)) if (y + dy, x + dx) in pixels]
    return [[(x + 0.5, y + 0.5) for y, x in path] for path in trace(edges) if len(path) >= 3]


def boundary_edges(labels: np.ndarray) -> list[tuple[Point, Point]]:
    """Unit edges between different labels and along the page, each once, as corner pairs (x, y)."""
    framed = np.pad(labels, 1, constant_values=-1)
    out = [((float(x), float(y)), (float(x), float(y + 1))) for y, x in np.argwhere(framed[1:-1, 1:] != framed[1:-1, :-1]).tolist()]
    return out + [((float(x), float(y)), (float(x + 1), float(y))) for y, x in np.argwhere(framed[1:, 1:-1] != framed[:-1, 1:-1]).tolist()]


def simplify(points: list[Point], tolerance: float) -> list[Point]:
    """Drop points within ``tolerance`` of the chord, by the farthest point first."""
    if tolerance <= 0 or len(points) < 3:
        return points
    p, keep, todo = np.array(points), {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, away = p[b] - p[a], p[a + 1 : b] - p[a]
        length = float(np.hypot(*chord))
        off = np.abs(chord[0] * away[:, 1] - chord[1] * away[:, 0]) / length if length else np.hypot(away[:, 0], away[:, 1])
        worst = int(off.argmax())
        if off[worst] > tolerance:
            keep.add(a + 1 + worst)
            todo += [(a, a + 1 + worst), (a + 1 + worst, b)]
    return [points[i] for i in sorted(keep)]


def mask_contours(mask: np.ndarray) -> list[list[Point]]:
    """Closed contours of a mask at half height, holes included: midpoints between set and unset pixels, in page units."""
    framed = np.pad(mask, 1).astype(bool)
    edges = []
    for y in range(framed.shape[0] - 1):
        for x in np.flatnonzero(framed[y, :-1] | framed[y, 1:] | framed[y + 1, :-1] | framed[y + 1, 1:]).tolist():
            a, b, c, d = framed[y, x], framed[y, x + 1], framed[y + 1, x + 1], framed[y + 1, x]
            top, right, bottom, left = (x + 0.5, y), (x + 1.0, y + 0.5), (x + 0.5, y + 1.0), (float(x), y + 0.5)
            crossed = [p for p, differs in ((top, a != b), (right, b != c), (bottom, c != d), (left, d != a)) if differs]
            if len(crossed) == 2:
                edges.append(tuple(crossed))
            elif len(crossed) == 4:  # set pixels that meet at a corner belong together
                edges += [(top, right), (bottom, left)] if a else [(top, left), (right, bottom)]
    return [[(px - 0.5, py - 0.5) for px, py in path] for path in trace([((float(p[0]), float(p[1])), (float(q[0]), float(q[1]))) for p, q in edges]) if len(path) >= 4]


def ring_area(ring: list[Point]) -> float:
    """The signed area of a closed line."""
    p = np.array(ring, float)
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def surrounds(ring: list[Point], point: Point) -> bool:
    """Whether a closed line goes round a point that is not on it."""
    p, (x, y) = np.array(ring, float), point
    (x0, y0), (x1, y1) = p[:-1].T, p[1:].T
    crossed = (y0 > y) != (y1 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x0 + (y - y0) * (x1 - x0) / (y1 - y0)
    return bool((crossed & (at > x)).sum() % 2)


def nest_rings(rings: list[list[Point]]) -> list[tuple[int, int]]:
    """For closed lines that do not cross: the number of the closest one around each (-1: none) and how many are around it; those at odd depth are holes."""
    if not rings:
        return []
    size = np.array([abs(ring_area(r)) for r in rings])
    low, high = np.array([np.min(r, axis=0) for r in rings]), np.array([np.max(r, axis=0) for r in rings])
    out = []
    for i, ring in enumerate(rings):
        # only larger ones whose box holds this one's can be around it
        near = np.flatnonzero((size > size[i]) & (low <= low[i]).all(axis=1) & (high >= high[i]).all(axis=1)).tolist()
        around = [j for j in near if surrounds(rings[j], ring[0])]
        out.append((min(around, key=size.__getitem__) if around else -1, len(around)))
    return out


# --- superpixels ----------------------------------------------------------------------------------------------------


def seed_centres(height: int, width: int, segments: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The step and the rows and columns of the first centres of a grid of about ``segments`` cells."""
    step = max(2.0, math.sqrt(height * width / segments))
    rows, columns = (np.arange(step / 2, n, step) if step / 2 < n else np.array([n / 2]) for n in (height, width))
    grid_y, grid_x = np.meshgrid(np.clip(np.rint(rows), 0, height - 1), np.clip(np.rint(columns), 0, width - 1), indexing="ij")
    return step, grid_y.ravel(), grid_x.ravel()


def slic(lab: np.ndarray, segments: int, compactness: float, rounds: int = 6, adaptive: bool = False) -> np.ndarray:
    """Superpixels by local k-means over colour and place within two steps of each centre.

    ``adaptive`` weighs place by each centre's own largest colour distance so far, and joins what is cut off to a neighbour.
    """
    height, width = lab.shape[:2]
    step, cy, cx = seed_centres(height, width, segments)
    centres = np.column_stack([lab[cy.astype(int), cx.astype(int)], cy, cx])
    yy, xx = np.mgrid[:height, :width]
    spread = np.full(len(centres), float(compactness) ** 2)
    labels = np.full((height, width), -1)
    channels = [np.ascontiguousarray(c) for c in np.moveaxis(lab, -1, 0)]
    for _ in range(rounds):
        best, colour_of = np.full((height, width), np.inf), np.zeros((height, width))
        for k, (l, a, b, y, x) in enumerate(centres):
            box = (slice(max(0, int(y - 2 * step)), int(y + 2 * step) + 1), slice(max(0, int(x - 2 * step)), int(x + 2 * step) + 1))
            colour = sum(np.square(channel[box] - value) for channel, value in zip(channels, (l, a, b)))
            place = np.square(yy[box[0], :1] - y) + np.square(xx[:1, box[1]] - x)
            cost = colour / spread[k] + place / step**2 if adaptive else colour + place * (compactness / step) ** 2
            nearer = cost < best[box]
            best[box][nearer] = cost[nearer]
            labels[box][nearer] = k
            colour_of[box][nearer] = colour[nearer]
        flat, full = labels.ravel()[labels.ravel() >= 0], labels.ravel() >= 0
        count = np.bincount(flat, minlength=len(centres))
        for i, values in enumerate([*channels, yy, xx]):
            total = np.bincount(flat, values.ravel()[full], minlength=len(centres))
            centres[count > 0, i] = total[count > 0] / count[count > 0]
        if adaptive:
            np.maximum.at(spread, flat, colour_of.ravel()[full])
    return connect_superpixels(labels, step) if adaptive else labels


def connect_superpixels(labels: np.ndarray, step: float) -> np.ndarray:
    """Give pieces smaller than a quarter cell to the neighbour with the longest shared boundary."""
    ids = label_components(labels, np.ones(labels.shape, bool), 4)
    numbers, counts = np.unique(ids, return_counts=True)
    graph = RegionGraph(dict(zip(numbers.tolist(), counts.tolist())), dict.fromkeys(numbers.tolist(), 0), dict.fromkeys(numbers.tolist(), int(step * step / 4)), shared_sides(ids))
    graph.merge_small(np.zeros((1, 3)), "boundary", math.inf)
    table = np.zeros(int(ids.max()) + 1, np.int64)
    for old, new in graph.renumbered().items():
        table[old] = new
    return table[ids] - 1
