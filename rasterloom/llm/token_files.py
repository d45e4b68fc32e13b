"""Token-id files: Simple-8b words with per-block offsets, in ascending doc_id order.

``write_token_files`` moves the texts once to ranges of doc_id, encodes each
range in order and writes it as one Parquet part.  A row holds a document's
words, the word offset of each block of ``simple8b.BLOCK`` ids, and the number
of ids before it in its part, so the place in the file and ``start`` cannot
differ, and any stretch can be decoded alone.  Spark's writers commit whole
tasks, so lost executors leave no half-written parts.

The number of parts follows the bytes of text (``PART_BYTES``).  Ranges are cut
by doc_id and a hash of the text, so null or equal doc_ids fill as many parts as
they need.  Only one sum per part reaches the driver.

Defined cases: a null text counts as empty and yields the end id alone; null
doc_ids come first; rows with equal doc_ids stand side by side, ordered by
their texts' hashes; other columns are ignored; an empty table gives files
without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from rasterloom.llm import simple8b
from rasterloom.llm.common import batch_slices, map_arrow
from rasterloom.llm.word_tokens import ended_ids, word_tokens

#: Bytes of text in a part, and rows that are decoded at once.
PART_BYTES = 64 << 20
DECODED_ROWS = 512


def parts_for(docs: DataFrame) -> int:
    """As many parts as the bytes of all texts ask for, and one for each core at least."""
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-held // PART_BYTES))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, parts: int | None = None) -> None:
    """Encode every text, append ``end_id`` and write the ids below ``path``."""
    schema = StructType([
        StructField("part", IntegerType()), StructField("part_start", LongType()), StructField("doc_id", docs.schema["doc_id"].dataType),
        StructField("n_tokens", LongType()), StructField("block_offsets", ArrayType(IntegerType(), False)), StructField("words", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        tokens, arrow, number, before = word_tokens(tokenizer_path), to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        for part in batch_slices(batches):
            values, lengths = ended_ids(tokens, part["text"], end_id)
            words, row_words, block_words = simple8b.encode(values, lengths)
            raw, ends = words.astype("<u8").tobytes(), np.concatenate([[0], np.cumsum(row_words)])
            offsets = np.cumsum(block_words) - block_words
            blocks = np.concatenate([[0], np.cumsum(-(-lengths // simple8b.BLOCK))])
            own = [(offsets[a:b] - w).tolist() for a, b, w in zip(blocks[:-1], blocks[1:], ends[:-1])]
            starts = before + np.cumsum(lengths) - lengths
            before += int(lengths.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(lengths), number, np.int32)), pa.array(starts), part["doc_id"].cast(arrow.field(2).type), pa.array(lengths), pa.array(own, arrow.field(4).type),
                    pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                ], schema=arrow,
            )

    by = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ranged = rows.repartitionByRange(parts or parts_for(docs), *by).sortWithinPartitions(*by)
    map_arrow(ranged.select("doc_id", "text"), run, schema).write.parquet(path)


def _decoded(part: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of every row, all blocks at once from their offsets."""
    lengths, raw = part["n_tokens"].to_numpy(), part["words"]
    row_words = np.array([len(w) // 8 for w in raw.to_pylist()], np.int64)
    words = np.frombuffer(b"".join(raw.to_pylist()), "<u8")
    first = np.cumsum(row_words) - row_words
    offsets = part["block_offsets"]
    blocks = np.repeat(first, np.diff(offsets.offsets.to_numpy())) + offsets.flatten().to_numpy(zero_copy_only=False)
    ids = simple8b.decode_blocks(words, blocks, simple8b.block_lengths(lengths))
    return np.split(ids, np.cumsum(lengths)[:-1])


def read_token_files(spark: SparkSession, path: str, finish: Callable[[np.ndarray], tuple] | None = None, fields: list[StructField] | None = None) -> DataFrame:
    """part, part_start, doc_id, n_tokens and what ``finish(ids)`` makes of each document's ids; the ids themselves where it is not given."""
    finish = finish or (lambda ids: (ids.tolist(),))
    fields = fields or [StructField("ids", ArrayType(LongType(), False))]
    files = spark.read.parquet(path).select("part", "part_start", "doc_id", "n_tokens", "block_offsets", "words")
    schema = StructType([*files.schema.fields[:4], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(at, DECODED_ROWS)
                rows = [finish(own) for own in _decoded(part)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(arrow.field(i).type) for i in range(4)), *(pa.array(list(c), arrow.field(4 + i).type) for i, c in enumerate(zip(*rows, strict=True)))], schema=arrow)

    return map_arrow(files, run, schema)


def read_stretches(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, first, stop and ids (``first`` to ``stop``, exclusive) for the rows of ``wanted``; only the blocks that hold them are decoded."""
    files = spark.read.parquet(path).select("doc_id", "n_tokens", "block_offsets", "words")
    met = files.join(wanted.select("doc_id", F.col("first").cast("long"), F.col("stop").cast("long")), "doc_id").select("doc_id", "first", "stop", "n_tokens", "block_offsets", "words")
    schema = StructType([met.schema["doc_id"], met.schema["first"], met.schema["stop"], StructField("ids", ArrayType(LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            found = []
            for first, stop, n, offsets, raw in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                found.append(simple8b.decode_range(np.frombuffer(raw, "<u8"), np.array(offsets, np.int64), n, first, stop).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(arrow.field(i).type) for i in range(3)), pa.array(found, arrow.field(3).type)], schema=arrow)

    return map_arrow(met, run, schema)


def crc_of_ids(ids: np.ndarray) -> tuple[int]:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


CRC_FIELDS = [StructField("ids_crc32", LongType())]


def with_starts(read: DataFrame, path: str) -> DataFrame:
    """``start``, the ids of all documents before each one, in place of part and part_start in rows of ``read_token_files``."""
    spark = read.sparkSession
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, rows = 0, []
    for r in sorted(totals, key=lambda r: r["part"]):
        rows.append((r["part"], base))
        base += r["n"]
    bases = spark.createDataFrame(rows, "part int, base long")
    return read.join(F.broadcast(bases), "part").withColumn("start", F.col("part_start") + F.col("base")).drop("part", "part_start", "base")
