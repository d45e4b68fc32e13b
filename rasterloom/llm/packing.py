"""Best-fit packing of token pieces into sequences by a linear grouping scheme.

All decisions are made on the histogram of piece lengths, which has at most as
many entries as a sequence has tokens.  Pieces that fill a sequence stand
alone.  Large lengths are split into groups of equal cardinality and rounded up
to their group's maximum; the few sizes' configurations are optimised by column
generation; the actual lengths take the places of the rounded ones; what is
left over and the small lengths follow in descending order by best fit.  The
plan gives each run of equal pieces, numbered within their length, its
sequences and offsets, so that every piece finds its place by its number.

Pieces are numbered per length and input partition where they arise; counts per
partition and length shift the numbers.  No length's pieces meet in one task.

Defined cases: a null or empty text gives one piece of the end id alone; only
documents longer than a sequence are cut; repeated rows are packed once each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rasterloom.llm.common import batch_slices, map_arrow
from rasterloom.llm.word_tokens import ended_ids, word_tokens
from rasterloom.session import materialize

GROUPS = 32
LARGE_PARTS = 8


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most (unbounded knapsack)."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.array(sizes)
    for room in range(min(sizes), capacity + 1):
        fitting = order <= room
        gains = np.where(fitting, value[room - np.minimum(order, room)] + worth, -1.0)
        best = int(gains.argmax())
        if gains[best] > value[room - 1] + 1e-12:
            value[room], choice[room] = gains[best], best
        else:
            value[room] = value[room - 1]
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] >= 0 and value[room] > value[room - 1]:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
        else:
            room -= 1
    return float(value[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each: the linear relaxation's optimum, rounded down."""
    if not sizes:
        return []
    k = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    wanted = np.array(demand, float)
    for _ in range(rounds):
        worth = np.linalg.solve(columns.T, np.ones(k))
        gain, new = best_configuration(sizes, np.maximum(worth, 0), capacity)
        if gain <= 1 + 1e-4:
            break
        amount, step = np.linalg.solve(columns, wanted), np.linalg.solve(columns, new)
        ratios = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(ratios.argmin())] = new
    amount = np.linalg.solve(columns, wanted)
    return [(columns[:, i].astype(int), int(n)) for i in range(k) if (n := np.floor(amount[i] + 1e-9)) > 0]


class _Runs:
    """Pieces of one group as runs (length, first number, count), longest first."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs = runs[::-1]

    def take(self, count: int) -> list[tuple[int, int, int]]:
        out = []
        while count and self.runs:
            length, first, n = self.runs.pop()
            got = min(n, count)
            out.append((length, first, got))
            if n > got:
                self.runs.append((length, first + got, n - got))
            count -= got
        return out


def _align(slots: list[list[tuple[int, int, int]]], bins: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Cut a configuration's bins into stretches in which each slot has pieces of one length (or none)."""
    cuts = {0, bins}
    for runs in slots:
        at = 0
        for _, _, n in runs:
            at += n
            cuts.add(min(at, bins))
    edges = sorted(cuts)
    at = [[0, 0] for _ in slots]
    for a, b in zip(edges, edges[1:]):
        held = []
        for k, runs in enumerate(slots):
            i, done = at[k]
            if i < len(runs):
                length, first, n = runs[i]
                held.append((length, first + done))
                at[k] = [i + 1, 0] if done + b - a == n else [i, done + b - a]
        yield b - a, held


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first number, count, first sequence, offset): piece number r of a length is in sequence first + r - first number."""
    classes: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # bins, [(length, first number, stride, times)]
    free: dict[int, list[tuple[int, list]]] = defaultdict(list)
    rooms: list[int] = []

    def put(bins: int, held: list[tuple[int, int, int, int]]) -> None:
        if not bins:
            return
        room = capacity - sum(length * times for length, _, _, times in held)
        if room == 0:
            classes.append((bins, held))
            return
        if not free[room]:
            insort(rooms, room)
        free[room].append((bins, held))

    lengths = sorted((n for n, count in histogram.items() if count), reverse=True)
    if lengths and lengths[0] > capacity:
        raise ValueError("a piece is longer than a sequence")
    limit = max(1, capacity // LARGE_PARTS)
    large = [n for n in lengths if limit < n < capacity]
    total = sum(histogram[n] for n in large)
    size = max(1, -(-total // groups))
    grouped: list[list[tuple[int, int, int]]] = []
    held = size
    for n in large:
        first, count = 0, histogram[n]
        while count:
            if held == size:
                grouped.append([])
                held = 0
            got = min(count, size - held)
            grouped[-1].append((n, first, got))
            first, count, held = first + got, count - got, held + got
    merged: dict[int, list[tuple[int, int, int]]] = {}
    for runs in grouped:
        merged.setdefault(runs[0][0], []).extend(runs)
    sizes = list(merged)
    runs = [_Runs(merged[s]) for s in sizes]
    demand = [sum(n for _, _, n in merged[s]) for s in sizes]
    if capacity in histogram and histogram[capacity]:
        put(histogram[capacity], [(capacity, 0, 1, 1)])
    for counts, bins in configurations(sizes, demand, capacity):
        slots = [runs[j].take(bins) for j in range(len(sizes)) for _ in range(counts[j])]
        for stretch, taken in _align(slots, bins):
            if taken:
                put(stretch, [(length, first, 1, 1) for length, first in taken])
    rest = [r for group in runs for r in reversed(group.runs)] + [(n, 0, histogram[n]) for n in lengths if n <= limit]
    for length, first, count in sorted(rest, key=lambda r: (-r[0], r[1])):
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                times = capacity // length
                if bins := count // times:
                    put(bins, [(length, first, bins, times)])
                if count % times:
                    put(1, [(length, first + bins * times, 1, count % times)])
                break
            room = rooms[at]
            bins, held_before = free[room].pop()
            if not free[room]:
                rooms.pop(at)
            times = room // length
            full = min(bins, count // times)
            put(full, [*held_before, (length, first, full, times)])
            first, count, done = first + full * times, count - full * times, full
            shifted = lambda by: [(n, r + by, stride, q) for n, r, stride, q in held_before]  # noqa: B023, E731
            if done < bins and count:
                put(1, [*shifted(done), (length, first, 1, count)])
                count, done = 0, done + 1
            put(bins - done, shifted(done))
    for room in rooms:
        classes.extend(free[room])
    rows, sequence = [], 0
    for bins, held_now in classes:
        offset = 0
        for length, first, stride, times in held_now:
            for k in range(times):
                rows.append((length, first + k * stride, bins, sequence, offset))
                offset += length
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of every document, numbered per length within their partition (``part``, ``nth``)."""
    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
        StructField("ids_crc32", LongType()), StructField("part", IntegerType()), StructField("nth", LongType()),
    ])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        tokens, arrow, number = word_tokens(tokenizer_path), to_arrow_schema(schema), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for part in batch_slices(batches):
            owner, rows = [], []
            values, counts = ended_ids(tokens, part["text"], end_id)
            ids, before = memoryview(values.tobytes()), 0
            for i, n in enumerate(counts.tolist()):
                for k, at in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - at)
                    owner.append(i)
                    rows.append((k, at, length, zlib.crc32(ids[4 * (before + at) : 4 * (before + at + length)]), number, seen[length]))
                    seen[length] += 1
                before += n
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(arrow.field(0).type).take(pa.array(owner, pa.int64())), *(pa.array(list(c), arrow.field(j + 1).type) for j, c in enumerate(columns))], schema=arrow)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = materialize(cut_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, capacity)
    key, first, sequence, offset = (rows[:, 0] << 44) + rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # the shifts grow with parts times lengths: merged, never broadcast
    numbered = pieces.join(shifts.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("shift")).alias("nth"))
    schema = StructType([*numbered.schema.fields[:5], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    sent = docs.sparkSession.sparkContext.broadcast((key, first, sequence, offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        key, first, sequence, offset = sent.value
        for batch in batches:
            nth = batch["nth"].to_numpy()
            at = np.searchsorted(key, (batch["length"].to_numpy() << 44) + nth, side="right") - 1
            place = [pa.array(sequence[at] + nth - first[at]), pa.array(offset[at])] if batch.num_rows else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(arrow.field(i).type) for i in range(5)), *place], schema=arrow)

    return map_arrow(numbered, run, schema)
