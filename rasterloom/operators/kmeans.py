"""k-means with oversampled seeding and several starts that run together.

Seeding takes few passes: in each, every point becomes a candidate with a chance
in proportion to its squared distance from the candidates so far, several times
as many as there are clusters.  The candidates, weighted by the points nearest to
them, are few; the driver picks the first centres of every start among them.
Then all starts go through the same rounds of assigning and averaging, in one job
a round, and the start with the least cost stays.

Chances come from a hash of the point, the start and the pass, and sums are whole
numbers of fixed point, so the result does not depend on how the points are
partitioned.  What reaches the driver is bounded by starts, clusters and the
size of a point.

Defined cases: points with a null or non-finite component are left out; there are
no more clusters than distinct points (to four decimals); no points give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import materialize

STARTS, SEED_PASSES, OVERSAMPLING, ROUNDS, SAMPLE = 10, 3, 2, 15, 100_000
#: Centres that move less have settled.
SETTLED = 1e-3
#: Fixed point of sums.
_POINT = 1 << 20


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return np.asarray(batch["v"].flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (of several the first) and the squared distance."""
    far = np.stack([np.square(points - c).sum(axis=1) for c in centres], 1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(points)), at]


def _fixed(values: np.ndarray) -> np.ndarray:
    return np.rint(values * _POINT).astype(np.int64)


def _passes(sample: DataFrame, centres: list[np.ndarray], size: int, sums: bool) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], np.ndarray], list[int]]:
    """Points (and, with ``sums``, component sums) of every start's centres, and every start's cost, in fixed point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(c), np.int64) for c in centres]
        costs = [np.zeros(len(c), np.int64) for c in centres]
        totals = [np.zeros((len(c), size), np.int64) for c in centres]
        for batch in batches:
            points = _matrix(batch, size)
            weight = batch["n"].to_numpy(zero_copy_only=False).astype(np.int64)
            fixed = _fixed(points) * weight[:, None]
            for s, own in enumerate(centres):
                at, far = _nearest(points, own)
                np.add.at(counts[s], at, weight)
                np.add.at(costs[s], at, _fixed(far) * weight)
                if sums:
                    np.add.at(totals[s], at, fixed)
        rows = [(s, c, int(counts[s][c]), int(costs[s][c]), totals[s][c].tolist()) for s in range(len(centres)) for c in range(len(centres[s])) if counts[s][c]]
        columns = list(zip(*rows)) or [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.list_(pa.int64()))], names=["start", "centre", "n", "cost", "total"])

    found = sample.mapInArrow(run, "start int, centre int, n long, cost long, total array<long>")
    added = found.groupBy("start", "centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total")).collect()
    cost = [0] * len(centres)
    for r in added:
        cost[r["start"]] += r["cost"]
    return {(r["start"], r["centre"]): r["n"] for r in added}, {(r["start"], r["centre"]): np.array(r["total"], np.float64) for r in added}, cost


def _candidates(sample: DataFrame, centres: list[np.ndarray], costs: list[int], k: int, size: int, turn: int) -> list[np.ndarray]:
    """Every start's further candidates: a point's chance is its share of the cost, times the oversampling."""
    wanted = OVERSAMPLING * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, hashes = _matrix(batch, size), batch["h"].to_numpy(zero_copy_only=False).astype(np.uint64)
            weight = batch["n"].to_numpy(zero_copy_only=False)
            starts, picked = [], []
            for s, own in enumerate(centres):
                if not costs[s]:
                    continue
                with np.errstate(over="ignore"):
                    mixed = (hashes ^ np.uint64(turn * 1000 + s + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(29)
                chance = (mixed >> np.uint64(11)).astype(np.float64) / (1 << 53)
                hit = chance < wanted * _nearest(points, own)[1] * weight * _POINT / costs[s]
                starts += [s] * int(hit.sum())
                picked += points[hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array(picked, pa.list_(pa.float64()))], names=["start", "v"])

    out: list[list] = [[] for _ in centres]
    for r in sample.mapInArrow(run, "start int, v array<double>").collect():
        out[r["start"]].append(r["v"])
    return [np.array(sorted(rows)).reshape(-1, size) for rows in out]


def _first_centres(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the weighted candidates, each by its squared distance from those before."""
    rng = np.random.default_rng(seed)
    chosen = [candidates[rng.choice(len(candidates), p=weight / weight.sum())]]
    far = np.square(candidates - chosen[0]).sum(axis=1)
    while len(chosen) < k:
        share = weight * far
        at = rng.choice(len(candidates), p=share / share.sum()) if share.sum() > 0 else rng.integers(len(candidates))
        chosen.append(candidates[at])
        far = np.minimum(far, np.square(candidates - chosen[-1]).sum(axis=1))
    return np.array(chosen)


def fit(points: DataFrame, k: int, size: int, rounds: int = ROUNDS, sample: int = SAMPLE, starts: int = STARTS) -> tuple[np.ndarray, float]:
    """The centres of the best start, in ascending order, and its cost on at most ``sample`` distinct points (column v)."""
    usable = F.col("v").isNotNull() & (F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rounded = points.where(usable).select(F.transform("v", lambda x: F.round(x, 4)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("v"))
    some = materialize(rounded.orderBy("h", "v").limit(sample), "kmeans-sample")
    k = min(k, some.count())
    if not k:
        return np.zeros((0, size)), 0.0
    first = some.orderBy("h", "v").limit(max(starts, k)).collect()
    centres = [np.array([first[s % len(first)]["v"]]) for s in range(starts)]
    _, _, costs = _passes(some, centres, size, False)
    for turn in range(SEED_PASSES):
        more = _candidates(some, centres, costs, k, size, turn)
        # where too few are picked, the first points by hash make up the number
        spare = [np.array([r["v"] for r in first]) if turn + 1 == SEED_PASSES and len(c) + len(m) < 2 * k else m[:0] for c, m in zip(centres, more)]
        centres = [np.unique(np.concatenate([c, m, x]), axis=0) for c, m, x in zip(centres, more, spare)]
        counts, _, costs = _passes(some, centres, size, False)
    seeds = [_first_centres(c, np.array([counts.get((s, i), 0) for i in range(len(c))], np.float64), k, s) for s, c in enumerate(centres)]
    for _ in range(rounds):
        counts, totals, costs = _passes(some, seeds, size, True)
        moved = [np.array([totals[s, i] / _POINT / counts[s, i] if (s, i) in counts else c for i, c in enumerate(own)]) for s, own in enumerate(seeds)]
        settled = all(np.abs(a - b).max() < SETTLED for a, b in zip(moved, seeds))
        seeds = moved
        if settled:
            break
    else:
        _, _, costs = _passes(some, seeds, size, False)
    best = min(range(starts), key=lambda s: (costs[s], s))
    order = np.lexsort(seeds[best].T[::-1])
    return seeds[best][order], costs[best] / _POINT


def fit_centres(points: DataFrame, k: int, size: int, **parameters) -> DataFrame:
    """centre and c of the best start."""
    centres, cost = fit(points, k, size, **parameters)
    rows = pd.DataFrame({"centre": pd.Series(range(len(centres)), dtype="int32"), "c": [c.tolist() for c in centres], "cost": pd.Series([cost] * len(centres), dtype="float64")})
    if math.isnan(cost) or not len(rows):
        return points.sparkSession.createDataFrame([], "centre int, c array<double>, cost double")
    return points.sparkSession.createDataFrame(rows, "centre int, c array<double>, cost double")
