"""Inserts that give back their rows: staged files, ids of a range of their own, one atomic publication.

A table is a folder of batches.  An insert writes its rows to a staging folder,
numbers them over their partitions, claims the next range of ids by creating a
file that must not exist, and publishes by renaming the finished folder to its
batch's name.  Readers see all of a batch or nothing of it; inserts at the same
time get ranges of their own.

The batch's name is the caller's token, so an insert that is repeated with the
same token, after a failure or by mistake, publishes once and gives back the rows
that are there.  Ids rise with the given order within a batch and are never used
twice; ranges of inserts that failed stay unused.

Renaming must be atomic and must refuse a name that exists, as on HDFS or local
disks; stores without it need a committer of their own.

Defined cases: rows whose required columns are null or blank are not inserted; an
insert of no rows publishes an empty batch; a table without batches reads as no rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from py4j.protocol import Py4JJavaError

#: Ids of one insert: its number, then the row's place.
PLACE_BITS = 40
_ROW_BITS = 33


class _Folder:
    """The file system of a path, through Hadoop."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def create(self, name: str) -> bool:
        """Create an empty file; false if it exists."""
        self.fs.mkdirs(self.at(name).getParent())
        try:
            self.fs.create(self.at(name), False).close()
        except Py4JJavaError as error:
            if "Exist" in error.java_exception.getClass().getSimpleName():
                return False
            raise
        return True

    def publish(self, staged: str, name: str) -> bool:
        """Rename a folder; false if the new name exists."""
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.gateway.new_array(options, 1)
        none[0] = options.NONE
        target = self.at(name)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.at(staged), target, none)
        except Py4JJavaError as error:
            if "Exist" in error.java_exception.getClass().getSimpleName() and self.fs.exists(target):
                return False
            raise
        return True

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _batch(token: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9.-]+", token):
        raise ValueError("a token has letters, digits, dots and hyphens")
    return f"batch={token}"


def insert(rows: DataFrame, path: str, token: str, order: list[str], required: tuple[str, ...] = ("title",)) -> DataFrame:
    """Insert the rows whose required columns are not blank (they are trimmed) and give them back with their ``id``."""
    spark, batch = rows.sparkSession, _batch(token)
    folder = _Folder(spark, path)
    if not folder.fs.exists(folder.at(batch)):
        for c in required:
            rows = rows.withColumn(c, F.trim(c))
        accepted = rows.where(" AND ".join(f"length({c}) > 0" for c in required)) if required else rows
        work = f"_staging/{token}-{uuid.uuid4().hex[:12]}"
        _stage(folder, accepted, work, order)
        folder.publish(f"{work}/done", batch)  # a twin with the same token may have been faster
        folder.drop(work)
    return spark.read.schema(StructType([*rows.schema.fields, *spark.range(0).schema.fields])).parquet(f"{folder.root}/{batch}")


def _stage(folder: _Folder, rows: DataFrame, work: str, order: list[str]) -> None:
    """Write the rows with their ids below ``work``."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(f"{folder.root}/{work}/rows")
    placed = spark.read.schema(placed.schema).parquet(f"{folder.root}/{work}/rows").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    # one row for each partition
    before, starts = 0, []
    for part, count in sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += count
    number = claim(folder)
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    named = placed.join(F.broadcast(offsets), "_part").withColumn("id", F.lit(number << PLACE_BITS) + place).drop("_part", "_before", "_at")
    named.write.parquet(f"{folder.root}/{work}/done")


def claim(folder: _Folder) -> int:
    """The number of a range of ids that nobody else has."""
    number = max([int(n) for n in folder.names("_claims") if n.isdigit()], default=0) + 1
    while not folder.create(f"_claims/{number}"):
        number += 1
    return number


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All published rows of a table, with ``id``."""
    folder = _Folder(spark, path)
    batches = [f"{folder.root}/{n}" for n in sorted(folder.names("")) if n.startswith("batch=")]
    full = StructType([*schema.fields, *spark.range(0).schema.fields])
    return spark.read.schema(full).parquet(*batches) if batches else spark.createDataFrame([], full)
