"""What the corpus operators share: text batches, bounded caches and fold expressions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts of at most this many characters together (or one longer text) are handled at once in a Python worker.
SLICE_CHARS = 2_000_000


class BoundedCache(dict):
    """A dict filled by ``make(key)``; emptied when it holds ``most`` entries, so a worker's memory stays bounded.

    Keys longer than ``longest`` are computed and not kept.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """The worker's one large object (tables and caches of an operator), made when it isn't the one of ``key``.

    Workers are reused by later stages; what an earlier operator held is let go first.
    """
    if key not in _HELD:
        release_held()
        _HELD[key] = make()
    return _HELD[key]


def release_held() -> None:
    """Let go of what an earlier operator held in this worker."""
    _HELD.clear()
    gc.collect()
    tidy()


def tidy() -> None:
    """Give freed memory back to the system; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library keeps freed memory otherwise
        trim(0)


def batch_slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of bounded text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and held + n > SLICE_CHARS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)
    batch = None
    tidy()


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """The slices and their texts (None stays None)."""
    for part in batch_slices(batches, column):
        yield part, part[column].to_pylist()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    return df.mapInArrow(fn, schema)


def id_fold(modulus: int, column: str = "doc_id") -> Column:
    """``crc32`` of the id as text, modulo ``modulus``; null ids have a null fold."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def empty_frame(df: DataFrame, schema: StructType) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)
