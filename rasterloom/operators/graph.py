"""Components of graphs and numbered rows, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.session import materialize

MOST_ROUNDS = 100
_ROW_BITS = 33


def contract(pairs: DataFrame) -> DataFrame:
    """image_id, node and component (the smallest node reachable) of every node of the edges (image_id, a, b).

    Each round points every node at its smallest neighbour, follows that once more and
    puts the edges between what is pointed at; nodes at least halve along every path.
    The edges that are left are written to the shared folder, each once.  Joins are
    by sorting: files of edges are small for their rows, which the driver would
    otherwise send out whole.
    """
    key = ["image_id"]
    ordered = lambda edges: edges.where("a <> b").select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, members = materialize(ordered(pairs.select(*key, "a", "b")), "edges"), None
    for _ in range(MOST_ROUNDS):
        if not edges.limit(1).count():
            nodes = pairs.select(*key, F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
            return members if members is not None else nodes
        both = edges.unionByName(edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy(*key, F.col("a").alias("node")).agg(F.min("b").alias("near")).select(*key, "node", F.least("node", "near").alias("parent")), "lowest")
        onward = low.select(*key, F.col("node").alias("parent"), F.col("parent").alias("beyond"))
        pointed = materialize(low.join(onward.hint("merge"), [*key, "parent"]).select(*key, "node", F.col("beyond").alias("parent")), "pointed")
        to = lambda end: pointed.select(*key, F.col("node").alias(end), F.col("parent").alias(f"to_{end}")).hint("merge")
        moved = edges.join(to("a"), [*key, "a"]).join(to("b"), [*key, "b"]).select(*key, F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        # what is pointed at may itself point on
        chained = pointed.join(to("b").withColumnRenamed("b", "parent"), [*key, "parent"]).select(*key, F.col("parent").alias("a"), F.col("to_b").alias("b"))
        if members is None:
            members = pointed.select(*key, "node", F.col("parent").alias("component"))
        else:
            members = members.join(to("b").withColumnRenamed("b", "component"), [*key, "component"], "left").select(*key, "node", F.coalesce("to_b", "component").alias("component"))
            members = materialize(members, "members")
        edges = materialize(ordered(moved.unionByName(chained)), "edges")
    raise RuntimeError("the components did not settle")


def number_rows(rows: DataFrame, within: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: each row's place within its group, from 1; groups of any size are spread over range partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *within, *order).sortWithinPartitions(*within, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    per = placed.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select(*within, "_part", "_from", before.alias("_before"))
    return placed.join(starts, [*within, "_part"]).withColumn(out, F.col("_before") + F.col("_at") - F.col("_from") + 1).drop("_at", "_part", "_from", "_before")
