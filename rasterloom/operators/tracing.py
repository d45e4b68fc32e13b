"""Tracing lines by list ranking: a graph's edges become paths without walking along any of them.

Nodes are whole numbers whose order is that of the points (``point_id``).  Every
edge is two darts, one for each direction.  A dart's successor is the only way on
behind a node with two neighbours; elsewhere the path ends.  Rings of such nodes
are cut at their smallest one.  Pointer doubling gives each dart the last dart of
its path and how far off that is: path and position in as many joins as the
longest path's length has bits.  Each path is there in both directions; the one
whose first two nodes are smaller stays.

Defined cases: edges given twice or in both directions count once, edges from a
node to itself not at all; a path that ends where it began is closed; a table
without edges gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from rasterloom.operators import kernels
from rasterloom.operators.graph import contract, number_rows
from rasterloom.session import materialize

#: Paths of up to two to this power of edges.
MOST_DOUBLINGS = 60
POINTS = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def point_id(first: Column, second: Column) -> Column:
    """A number for whole, non-negative coordinates that sorts as they do."""
    return F.shiftleft(first.cast("long"), 32).bitwiseOR(second.cast("long"))


def first_of(node: str) -> Column:
    return F.shiftright(node, 32)


def second_of(node: str) -> Column:
    return F.col(node).bitwiseAND(0xFFFFFFFF)


def _ring_starts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """image_id and node of the smallest node of every component in which all nodes have two neighbours."""
    inner = nodes.where("degree = 2").select("image_id", "node")
    ends = lambda c: inner.withColumnRenamed("node", c)
    within = materialize(edges.join(ends("a"), ["image_id", "a"], "left_semi").join(ends("b"), ["image_id", "b"], "left_semi").select("image_id", "a", "b"), "inner-edges")
    parts = contract(within)
    sizes = parts.groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("nodes"))
    links = within.join(parts.withColumnRenamed("node", "a"), ["image_id", "a"]).groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("links"))
    # a chain has one link fewer than nodes
    return sizes.join(links, ["image_id", "component"]).where("nodes = links").select("image_id", F.col("component").alias("node"))


def trace(edges: DataFrame, least_points: int = 2) -> DataFrame:
    """image_id, path_id, position and node of the paths that cover the edges (image_id, a, b), each edge once.

    Open paths are numbered from 0 by their first two nodes, rings behind them; paths of fewer than ``least_points`` points are left out.
    """
    at = ["image_id"]
    edges = materialize(edges.where("a <> b").select(*at, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    darts = edges.unionByName(edges.select(*at, F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = materialize(darts.groupBy(*at, F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("low"), F.max("b").alias("high")), "nodes")
    rings = materialize(_ring_starts(edges, nodes), "rings").withColumn("cut", F.lit(True))
    passed = nodes.join(rings, [*at, "node"], "left").where("degree = 2 AND cut IS NULL").select(*at, F.col("node").alias("b"), "low", "high")
    onward = darts.join(passed, [*at, "b"], "left").select(*at, "a", "b", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("c"))
    # (ta, tb): the dart that is ``steps`` further on; open: that dart has a successor
    state = onward.select(
        *at, "a", "b", F.when(F.col("c").isNull(), F.col("a")).otherwise(F.col("b")).alias("ta"), F.coalesce("c", "b").alias("tb"), F.when(F.col("c").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("c").isNotNull().alias("open")
    )
    state = materialize(state, "darts")
    for _ in range(MOST_DOUBLINGS):
        if not state.where("open").limit(1).count():
            break
        # where a dart has got to, and how far from there that one has got
        beyond = state.select(*at, F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("ta").alias("na"), F.col("tb").alias("nb"), F.col("steps").alias("more"), F.col("open").alias("still"))
        moved = state.where("open").join(beyond, [*at, "ta", "tb"]).select(*at, "a", "b", F.col("na").alias("ta"), F.col("nb").alias("tb"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        state = materialize(state.where("NOT open").unionByName(moved), "darts")
    else:
        raise RuntimeError("the paths did not end")
    heads = state.groupBy(*at, "ta", "tb").agg(F.max(F.struct("steps", "a", "b")).alias("head"))
    heads = heads.select(*at, "ta", "tb", F.col("head.a").alias("start"), F.col("head.b").alias("then"), (F.col("head.steps") + 1).alias("n"))
    kept = heads.where((F.struct("start", "then") <= F.struct(F.col("tb").alias("start"), F.col("ta").alias("then"))) & (F.col("n") + 1 >= least_points))
    ringed = rings.withColumnRenamed("node", "start")
    numbered = number_rows(kept.join(ringed, [*at, "start"], "left").withColumn("ring", F.col("cut").isNotNull()), at, ["ring", "start", "then"], "number").withColumn("path_id", (F.col("number") - 1).cast("long"))
    path = materialize(numbered.select(*at, "ta", "tb", "path_id", "start", "n"), "paths")
    behind = state.join(path, [*at, "ta", "tb"]).select(*at, "path_id", (F.col("n") - F.col("steps")).alias("position"), F.col("b").alias("node"))
    return path.select(*at, "path_id", F.lit(0).cast("long").alias("position"), F.col("start").alias("node")).unionByName(behind)


def lines(traced: DataFrame, x: Column, y: Column) -> DataFrame:
    """image_id, path_id and points in order; ``x`` and ``y`` are made of ``node``."""
    held = traced.groupBy("image_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("position", x.cast("double").alias("x"), y.cast("double").alias("y")))).alias("held"))
    return held.select("image_id", "path_id", F.transform("held", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def boundary_edges(pixels: DataFrame, label: str) -> DataFrame:
    """Unit edges between different labels and along the image's border, each once, as corners whose order is (x, y)."""

    def sides(axis: str, across: str) -> Column:
        """Places along the axis at which this pixel has an edge: before it, and behind the last."""
        line = Window.partitionBy("image_id", across).orderBy(axis)
        before = F.coalesce((F.lag(label).over(line) != F.col(label)) | (F.lag(axis).over(line) != F.col(axis) - 1), F.lit(True))
        last = F.coalesce(F.lead(axis).over(line) != F.col(axis) + 1, F.lit(True))
        return F.array_compact(F.array(F.when(before, F.col(axis)), F.when(last, F.col(axis) + 1)))

    x, y = F.col("x"), F.col("y")
    upright = pixels.select("image_id", "y", sides("x", "y").alias("at")).select("image_id", "y", F.explode("at").alias("x")).select("image_id", point_id(x, y).alias("a"), point_id(x, y + 1).alias("b"))
    level = pixels.select("image_id", "x", sides("y", "x").alias("at")).select("image_id", "x", F.explode("at").alias("y")).select("image_id", point_id(x, y).alias("a"), point_id(x + 1, y).alias("b"))
    return upright.unionByName(level)


def boundary_lines(pixels: DataFrame, label: str) -> DataFrame:
    """Boundaries between labels as lines of corners: image_id, path_id, points."""
    return lines(trace(boundary_edges(pixels, label)), first_of("node"), second_of("node"))


def skeleton_edges(pixels: DataFrame, mask: str) -> DataFrame:
    """Edges between set pixels that touch, as places whose order is (y, x)."""
    held = pixels.where(mask).select("image_id", "x", "y")
    steps = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = held.select("image_id", point_id(F.col("y"), F.col("x")).alias("a"), F.explode(steps).alias("to")).select("image_id", "a", F.col("to.x").alias("x"), F.col("to.y").alias("y"))
    return ahead.join(held, ["image_id", "x", "y"]).select("image_id", "a", point_id(F.col("y"), F.col("x")).alias("b"))


def skeleton_lines(pixels: DataFrame, mask: str) -> DataFrame:
    """A skeleton's strokes of at least three pixels as lines of pixel centres: image_id, path_id, points."""
    return lines(trace(skeleton_edges(pixels, mask), 3), second_of("node") + 0.5, first_of("node") + 0.5)


@F.pandas_udf(POINTS)
def _simplified(points: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([[{"x": x, "y": y} for x, y in kernels.simplify([(p["x"], p["y"]) for p in line], t)] for line, t in zip(points, tolerance)])


def simplified(points: str, tolerance: float) -> Column:
    """Lines without the points that are within ``tolerance`` of the chords of what is left."""
    return _simplified(F.col(points), F.lit(tolerance))
