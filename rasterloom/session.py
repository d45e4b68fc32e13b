"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
#: The paths of the innermost ``scratch_scope`` of this thread.
_SCOPE: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scratch_scope", default=None)
_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "rasterloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on this machine alone."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            found = existing.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            found = f"file://{tempfile.mkdtemp(prefix='rasterloom-')}"
        else:
            raise RuntimeError(f"{_SETTING} must name a folder that the driver and all executors share")
        spark.conf.set(_SETTING, found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when its scope or the driver ends."""
    path = f"{shared_dir(spark)}/rasterloom-scratch/{name}-{uuid.uuid4().hex[:12]}"
    scope = _SCOPE.get()
    (_WRITTEN if scope is None else scope).append((spark, path))
    return path


@contextmanager
def scratch_scope() -> Iterator[None]:
    """What this thread writes to the shared folder inside is removed behind it; results must be read before."""
    own: list[tuple[SparkSession, str]] = []
    token = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        _remove(own)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """A file with these bytes in the shared folder, written through Spark's own file systems."""
    path = f"{scratch_path(spark, 'upload')}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def _remove(paths: list[tuple[SparkSession, str]]) -> None:
    while paths:
        spark, path = paths.pop()
        jvm = spark.sparkContext._jvm
        if jvm is None or spark.sparkContext._jsc is None:
            continue
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def release_scratch() -> None:
    """Delete every scratch table written by this driver outside of scopes."""
    _remove(_WRITTEN)


def _at_exit() -> None:
    from py4j.protocol import Py4JError, Py4JNetworkError

    try:
        release_scratch()
    except (Py4JError, Py4JNetworkError, OSError, AttributeError):
        _WRITTEN.clear()


atexit.register(_at_exit)
