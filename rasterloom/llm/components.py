"""Connected components of an edge table by contraction of large and small stars.

Each task first joins its own edges in a union-find, which leaves at most one
edge per node and task.  Then every node points to the smallest node it sees
until nothing changes.  Nodes are integers; all rows stay in Spark, and each
round's edges are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import materialize

MOST_ROUNDS = 60
#: A task holds at most about this many nodes at once.
LOCAL_NODES = 300_000


class UnionFind:
    """Joins nodes; every component is named by its smallest node."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        top = node
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[node]) != top:
            parent[node], node = top, up
        return top

    def join(self, left: list[int], right: list[int]) -> None:
        for a, b in zip(left, right):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def roots(self) -> dict[int, int]:
        return {node: self.root(node) for node in list(self.parent)}


def union_find(left: list[int], right: list[int]) -> dict[int, int]:
    """Node to smallest node of its component, for the nodes of these edges."""
    joined = UnionFind()
    joined.join(left, right)
    return joined.roots()


def _local(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with b the smallest node that up to ``LOCAL_NODES`` nodes' edges in a task join a to."""

    def stars(joined: UnionFind) -> pa.RecordBatch:
        pairs = np.array([(a, b) for a, b in joined.roots().items() if a != b], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = UnionFind()
        for batch in batches:
            joined.join(batch["a"].to_pylist(), batch["b"].to_pylist())
            if len(joined.parent) > LOCAL_NODES:
                yield stars(joined)
                joined = UnionFind()
        yield stars(joined)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of the edges (a, b)."""
    current = materialize(_local(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "edges")
    for _ in range(MOST_ROUNDS):
        # every node with more than one smaller neighbour hands all of them to the smallest
        least = current.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most"))
        least = materialize(least, "least")
        open_nodes = least.where("least < most").limit(1).count()
        # and a star's centre must not point on
        # (only few centres do, so a large component's nodes need not meet its centre in one task)
        centres = least.select("least").distinct()
        onward = least.select(F.col("a").alias("least"), F.col("least").alias("next")).join(centres, "least", "left_semi")
        chained = least.join(onward, "least", "left")
        moving = chained.where("next is not null").limit(1).count()
        if not open_nodes and not moving:
            return least.select(F.col("a").alias("node"), F.col("least").alias("component")).unionByName(
                least.select(F.col("least").alias("node")).distinct().select("node", F.col("node").alias("component"))
            )
        target = materialize(chained.select("a", F.coalesce("next", "least").alias("to")), "targets")
        # an edge (a, b) becomes (b, to(a)); a itself is joined to to(a)
        handed = current.join(target, "a").where("b <> to").select(F.greatest("b", "to").alias("a"), F.least("b", "to").alias("b"))
        kept = target.where("a <> to").select("a", F.col("to").alias("b"))
        current = materialize(_local(kept.unionByName(handed).distinct()), "edges")
    raise RuntimeError("the components did not settle")


#: Classes of at least one in so many rows are joined by broadcast: there cannot be more of them than this.
HOT_SHARE = 1000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` rows with the columns of their class (keys, and ``weight``, its number of rows, which is dropped).

    Rows without a class are left out.  Frequent classes are broadcast, so that no task gets all rows of one.
    """
    often = F.col("weight") * HOT_SHARE >= n
    hot, rest = classes.where(often).drop("weight"), classes.where(~often).drop("weight")
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))
