"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c are at distance sqrt(2 - 2c), so links at a least
cosine are a similarity join with that distance as epsilon.  Vectors are turned
into the leading principal directions and sorted by their grid cells of width
epsilon (epsilon grid order).  The order is cut into blocks; pairs of blocks of
one group whose boxes are farther apart than epsilon in these directions are
never brought together.  Consecutive blocks form tiles, and tiles are brought
together in pairs, so a block moves once for a pair of tiles, not for each block
that it meets.  Blocks are joined recursively: both intervals are halved, pairs
of intervals that are provably distant are skipped, and small ones are compared
by their cosines in double precision.

Equal vectors of a group are one class from the start and are never expanded
into pairs.  A pair of tiles gives back sums of links per class and a spanning
forest, so what leaves it is no more than what entered.

The directions are fitted on at most ``SAMPLE_VECTORS`` vectors; they decide only
how much is skipped.

Defined cases: rows with null label, null or zero vector, or null or non-finite
components link with nothing and stand alone; vectors of different lengths are
not compared; equal rows (also of equal id) are linked copies; rows with a null
id are linked and counted but cannot give a component its id (null if it has no
other); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from rasterloom.llm.common import map_arrow
from rasterloom.llm.components import connected_components, join_classes, union_find
from rasterloom.session import materialize

LEAST_COSINE = 0.93
DIRECTIONS = 6
SAMPLE_VECTORS = 10_000
BLOCK_ROWS = 2048
#: Blocks in a tile; a task holds two tiles.
TILE_BLOCKS = 8
LEAF_ROWS = 128
#: Room for rounding when boxes are compared.
SLACK = 1e-6
_ALONE = 1 << 62
_SAFE_SQUARE = 1e-280


def _usable(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray | None]]:
    vectors: list[np.ndarray | None] = []
    for row in column.to_pylist():
        vector = None
        if row and None not in row:
            found = np.array(row, np.float64)
            if np.isfinite(found).all() and found.any():
                with np.errstate(over="ignore", under="ignore"):
                    size = float(found @ found)
                if not _SAFE_SQUARE <= size <= 1 / _SAFE_SQUARE:
                    # squares would leave the range of doubles; the direction stays
                    found = found / np.abs(found).max()
                vector = found + 0.0  # no negative zeros
        vectors.append(vector)
    return np.array([v is not None for v in vectors]), vectors


def principal_directions(vectors: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """The leading principal directions of unit vectors, one per column."""
    if len(vectors) < 2:
        return np.eye(vectors.shape[1])[:, :count]
    centred = vectors - vectors.mean(axis=0)
    _, turned = np.linalg.eigh(centred.T @ centred)
    return turned[:, ::-1][:, :count]


def fit_directions(rows: DataFrame, sample: int = SAMPLE_VECTORS) -> dict[int, np.ndarray]:
    """Directions for each vector length in a sample picked by a hash of the id."""
    picked = rows.select("embedding").where("embedding is not null").orderBy(F.xxhash64("vec_id")).limit(sample).collect()
    by_size: dict[int, list] = {}
    ok, vectors = _usable(pa.array([r["embedding"] for r in picked], pa.list_(pa.float64())))
    for v in vectors:
        if v is not None:
            by_size.setdefault(len(v), []).append(v / np.linalg.norm(v))
    return {size: principal_directions(np.array(own)) for size, own in by_size.items()}


def _placed(rows: DataFrame, directions: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """vec_id, grp, size, mark (identity of the vector), cells and raw vector of every row; mark is null for rows that link with nothing."""
    schema = StructType([
        StructField("vec_id", LongType()), StructField("grp", LongType()), StructField("size", IntegerType()), StructField("mark", BinaryType()),
        StructField("cells", ArrayType(IntegerType(), False)), StructField("raw", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            ok, vectors = _usable(batch["embedding"])
            ok &= ~batch["grp"].is_null().to_numpy(zero_copy_only=False)
            sizes, marks, cells, raws = [], [], [], []
            for good, v in zip(ok.tolist(), vectors):
                if not good:
                    sizes.append(None), marks.append(None), cells.append(None), raws.append(None)
                    continue
                raw = v.tobytes()
                turn = directions.get(len(v))
                sizes.append(len(v)), raws.append(raw), marks.append(hashlib.sha256(raw).digest())
                cells.append([] if turn is None else np.floor(v / np.linalg.norm(v) @ turn / epsilon).astype(int).tolist())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["grp"], pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()), pa.array(cells, arrow.field(4).type), pa.array(raws, pa.binary())], schema=arrow)

    return map_arrow(rows.select("vec_id", F.col("label").cast("long").alias("grp"), "embedding"), run, schema)


def _blocks(classes: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of classes in epsilon grid order: their members, box in the leading directions and vectors."""
    schema = StructType([
        StructField("block", LongType()), StructField("grp", LongType()), StructField("size", IntegerType()), StructField("n", IntegerType()),
        StructField("low", ArrayType(DoubleType(), False)), StructField("high", ArrayType(DoubleType(), False)),
        StructField("cls", ArrayType(LongType(), False)), StructField("weight", ArrayType(LongType(), False)), StructField("raw", BinaryType()),
    ])

    def emit(arrow, number, rows):
        grp, size = rows[0][0], rows[0][1]
        vectors = np.frombuffer(b"".join(r[4] for r in rows)).reshape(len(rows), size)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        place = unit @ directions[size] if size in directions else np.zeros((len(rows), 0))
        values = [[number], [grp], [size], [len(rows)], [place.min(axis=0).tolist()], [place.max(axis=0).tolist()], [[r[2] for r in rows]], [[r[3] for r in rows]], [unit.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, base, done, held = to_arrow_schema(schema), TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("grp", "size", "cls", "weight", "raw"))):
                if held and (len(held) == BLOCK_ROWS or row[:2] != held[0][:2]):
                    yield emit(arrow, base + done, held)
                    done, held = done + 1, []
                held.append(row)
        if held:
            yield emit(arrow, base + done, held)

    return map_arrow(classes, run, schema)


def join_intervals(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, same: bool, epsilon: float, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine of at least ``least``; ``pa_`` and ``pb`` are places in the leading directions."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1 or (same and b1 <= a0):
            continue
        gap = np.maximum(0, np.maximum(pa_[a0:a1].min(0) - pb[b0:b1].max(0), pb[b0:b1].min(0) - pa_[a0:a1].max(0))) if pa_.shape[1] else np.zeros(0)
        if float(gap @ gap) > (epsilon + SLACK) ** 2:
            continue
        if a1 - a0 <= LEAF_ROWS and b1 - b0 <= LEAF_ROWS:
            i, j = np.nonzero(a[a0:a1] @ b[b0:b1].T >= least)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        halves_a = [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)] if a1 - a0 > LEAF_ROWS else [(a0, a1)]
        halves_b = [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)] if b1 - b0 > LEAF_ROWS else [(b0, b1)]
        todo += [(*x, *y) for x in halves_a for y in halves_b]


def _joined(tiles: DataFrame, directions: dict[int, np.ndarray], epsilon: float, least: float) -> DataFrame:
    """Per pair of tiles (ta, tb), from their blocks: rows (a, b, links): links of class a where b is null, else an edge of the forest."""

    def run(group: pa.Table) -> pa.Table:
        first, second = group["ta"][0].as_py(), group["tb"][0].as_py()
        blocks = []
        for row in group.select(["block", "tile", "grp", "size", "cls", "weight", "raw"]).to_pylist():
            unit = np.frombuffer(row["raw"]).reshape(-1, row["size"])
            place = unit @ directions[row["size"]] if row["size"] in directions else np.zeros((len(unit), 0))
            blocks.append((row["block"], row["tile"], (row["grp"], row["size"]), unit, place, np.array(row["cls"], np.int64), np.array(row["weight"], np.int64)))
        links: dict[int, int] = {}
        forest: dict[int, int] = {}
        for x in blocks:
            for y in blocks:
                if x[1] != first or y[1] != second or x[0] > y[0] or x[2] != y[2]:
                    continue
                _, _, _, ua, pa_, ca, wa = x
                _, _, _, ub, pb, cb, wb = y
                links_a, links_b = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64)
                for i, j in join_intervals(ua, ub, pa_, pb, x[0] == y[0], epsilon, least):
                    if not len(i):
                        continue
                    np.add.at(links_a, i, wb[j])
                    np.add.at(links_b, j, wa[i])
                    forest = union_find([*forest.keys(), *ca[i].tolist()], [*forest.values(), *cb[j].tolist()])
                for classes, sums in ((ca, links_a), (cb, links_b)):
                    for k in np.flatnonzero(sums).tolist():
                        links[int(classes[k])] = links.get(int(classes[k]), 0) + int(sums[k])
        ends = [(p, q) for p, q in forest.items() if p != q]
        return pa.table({
            "a": pa.array([*links, *(p for p, _ in ends)], pa.int64()), "b": pa.array([*[None] * len(links), *(q for _, q in ends)], pa.int64()), "links": pa.array([*links.values(), *[None] * len(ends)], pa.int64()),
        })

    return tiles.groupBy("ta", "tb").applyInArrow(run, "a long, b long, links long")


def near_duplicates(rows: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector (columns vec_id, embedding and label are read)."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * least))
    directions = fit_directions(rows)
    placed = materialize(_placed(rows, directions, epsilon), "placed")
    usable = placed.where("mark is not null")
    # one class per distinct vector of a group, named by its smallest id
    nameless = F.lit(_ALONE) + F.xxhash64("grp", "mark").bitwiseAND(F.lit(_ALONE - 1))
    classes = materialize(usable.groupBy("grp", "mark").agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("weight"), F.first("size").alias("size"), F.first("cells").alias("cells"), F.first("raw").alias("raw")).withColumn("cls", F.coalesce("smallest", nameless)), "classes")
    ordered = classes.orderBy("grp", "size", "cells", "cls").select("grp", "size", "cls", "weight", "raw")
    blocks = materialize(_blocks(ordered, directions), "blocks")
    # blocks meet on the cells of the first direction that they reach
    reach = F.when(F.size("low") > 0, F.sequence(F.floor(F.col("low")[0] / epsilon - SLACK).cast("int"), F.floor(F.col("high")[0] / epsilon + SLACK).cast("int"))).otherwise(F.array(F.lit(0)))
    boxes = blocks.select("block", "grp", "size", "low", "high", reach.alias("reach"))
    left = boxes.select("grp", "size", F.col("block").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"), F.explode("reach").alias("cell"))
    wide = F.expr("transform(sequence(-1, size(reach)), i -> reach[0] + i)")
    right = boxes.select("grp", "size", F.col("block").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"), F.explode(wide).alias("cell"))
    apart = F.expr("aggregate(zip_with(zip_with(al, bh, (x, y) -> greatest(x - y, 0D)), zip_with(bl, ah, (x, y) -> greatest(x - y, 0D)), (x, y) -> greatest(x, y)), 0D, (s, x) -> s + x * x)")
    pairs = left.join(right, ["grp", "size", "cell"]).where((F.col("a") <= F.col("b")) & (apart <= (epsilon + SLACK) ** 2)).select("a", "b").distinct()
    # a block goes once to every pair of tiles in which it meets another
    tile = lambda block: (F.shiftright(F.col(block), 32) * (1 << 32) + F.floor(F.col(block) % (1 << 32) / TILE_BLOCKS)).cast("long")
    met = pairs.select(tile("a").alias("ta"), tile("b").alias("tb"), F.explode(F.array("a", "b")).alias("block")).distinct()
    payload = blocks.select("block", tile("block").alias("tile"), "grp", "size", "cls", "weight", "raw")
    found = materialize(_joined(met.join(payload, "block"), directions, epsilon, least), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    joined = materialize(connected_components(found.where("b is not null").select("a", "b")), "components")
    named = F.coalesce("component", "cls")
    summed = classes.select("grp", "mark", "cls", "weight").join(links, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    own = materialize(summed.select("grp", "mark", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.when(named < _ALONE, named).alias("component_id")), "class-links")
    # vectors that link with nothing meet no class: they stay where they are
    alone = placed.where("mark is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = join_classes(usable.select("vec_id", "grp", "mark"), own, ["grp", "mark"], placed.count()).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach(id, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id WHERE r.low < l.b),
c AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
