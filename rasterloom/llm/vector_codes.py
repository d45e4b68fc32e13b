"""Codes for vectors: each part of a vector becomes the number of its nearest codebook entry.

Components become integers, so every distance, mean and tie is exact.  The
nearest entry is searched with segment-mean lower bounds: a part and an entry
are cut into one, then two, then four blocks; means and residual norms of the
blocks bound their distance from below, and an entry leaves as soon as its bound
is above the best exact distance seen.  Only what is left gets exact integer
distances.  Bounds are widened by more than their rounding, so no nearest entry
is ever lost.

Tasks read the vectors, hold the codebooks (``ENTRIES`` for each part) and give
back sums for each entry; Spark adds them and the driver gets one number for each
component of an entry.  No vector is shuffled.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; vectors of each length have codebooks of their own (a length that
four does not divide gives parts whose lengths differ by one; parts without
components have distance zero to entry zero); with fewer vectors than entries
the codebook has as many entries as vectors; equal vec_ids are ordered by
vector, null ones come last; components beyond ``CLAMP`` count as ``CLAMP``, and
an error beyond 64 bits as the largest number of 64 bits; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rasterloom.llm.common import empty_frame, map_arrow
from rasterloom.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CLAMP = 1 << 40
#: Blocks of a part, coarse to fine.
LEVELS = (1, 2, 4)
CHUNK_ROWS = 1024
#: A task hands its sums over after as many rows: they stay below 64 bits.
FLUSH_ROWS = 1 << 20
#: Labels with at least this share of the rows are joined by broadcast; there are no more than its inverse.
HEAVY_LABELS = 500
LONGEST = (1 << 63) - 1
_SLACK = 1e-9


def cuts(size: int, parts: int) -> list[int]:
    return [size * i // parts for i in range(parts + 1)]


def integer_vectors(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose vector has this length and is usable, and their integer components."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(counts) - counts
    bad = np.bincount(np.repeat(np.arange(len(counts)), counts)[~np.isfinite(flat)], minlength=len(counts)) > 0
    rows = np.flatnonzero((counts == size) & column.is_valid().to_numpy(zero_copy_only=False) & ~bad)
    with np.errstate(over="ignore"):
        scaled = flat[starts[rows][:, None] + np.arange(size)] * SCALE
    return rows, np.floor(np.clip(scaled, -CLAMP, CLAMP)).astype(np.int64)


class PartSearch:
    """Nearest entries of one part's codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.width = entries.shape[1]
        self.levels = [cuts(self.width, b) for b in LEVELS if b <= self.width]
        self.shapes = [self._shape(entries, at) for at in self.levels]
        self.reach = int(np.abs(entries).max(initial=0))

    @staticmethod
    def _shape(values: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, mean and residual norm of each block."""
        blocks = [values[:, a:b].astype(np.float64) for a, b in zip(at, at[1:])]
        means = np.stack([b.mean(axis=1) for b in blocks], 1)
        rest = np.stack([np.linalg.norm(b - m[:, None], axis=1) for b, m in zip(blocks, means.T)], 1)
        return np.diff(at).astype(np.float64), means, rest

    def exact(self, values: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distances row by row, in integers of any size."""
        reach = self.reach + int(np.abs(values).max(initial=0))
        if self.width * reach * reach < 1 << 62:
            return np.square(values - entries).sum(axis=1)
        return ((values.astype(object) - entries.astype(object)) ** 2).sum(axis=1)

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (of several the first) and the squared distance."""
        n = len(values)
        if not n or not self.width:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        size = np.linalg.norm(values.astype(np.float64), axis=1) + np.linalg.norm(self.entries.astype(np.float64), axis=1).max()
        room = _SLACK * np.square(size)
        best = None
        row = col = None
        for at, (length, means, rest) in zip(self.levels, self.shapes):
            _, own_means, own_rest = self._shape(values, at)
            if row is None:
                bound = length[0] * np.square(own_means - means.T) + np.square(own_rest - rest.T)
                guess = bound.argmin(axis=1)
                best = self.exact(values, self.entries[guess])
                row, col = np.nonzero(bound <= (best.astype(np.float64) * (1 + _SLACK) + room)[:, None])
                continue
            bound = sum(k * np.square(own_means[row, b] - means[col, b]) + np.square(own_rest[row, b] - rest[col, b]) for b, k in enumerate(length))
            # the entry with the least bound is likely near: its distance lets others go
            first = np.searchsorted(row, np.arange(n))
            least = np.minimum.reduceat(bound, first)
            at_least = np.flatnonzero(bound == least[row])
            _, pick = np.unique(row[at_least], return_index=True)
            best = np.minimum(best, self.exact(values, self.entries[col[at_least[pick]]]))
            kept = bound <= (best.astype(np.float64) * (1 + _SLACK) + room)[row]
            row, col = row[kept], col[kept]
        distance = self.exact(values[row], self.entries[col])
        least = np.minimum.reduceat(distance, np.searchsorted(row, np.arange(n)))
        hit = np.flatnonzero(distance == least[row])
        _, pick = np.unique(row[hit], return_index=True)
        return col[hit[pick]], least


class VectorCodes:
    """The codebooks of vectors of one length."""

    def __init__(self, codebooks: list[np.ndarray]):
        self.codebooks = codebooks
        self.size = sum(c.shape[1] for c in codebooks)
        self.at = cuts(self.size, len(codebooks))
        self.search = [PartSearch(c) for c in codebooks]

    @classmethod
    def starting(cls, vectors: np.ndarray, parts: int = PARTS) -> VectorCodes:
        at = cuts(vectors.shape[1], parts)
        return cls([vectors[:, a:b] for a, b in zip(at, at[1:])])

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, list]:
        """Entry numbers (one row for each part) and the distances summed over parts."""
        codes = np.empty((len(self.codebooks), len(vectors)), np.int64)
        errors: list = []
        for start in range(0, len(vectors), CHUNK_ROWS):
            own = vectors[start : start + CHUNK_ROWS]
            total = [0] * len(own)
            for p, (search, a, b) in enumerate(zip(self.search, self.at, self.at[1:])):
                codes[p, start : start + CHUNK_ROWS], distance = search.nearest(own[:, a:b])
                total = [t + d for t, d in zip(total, distance.tolist())]
            errors += total
        return codes, errors

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that entry numbers (one row for each part) stand for, in the scale of the input."""
        return np.concatenate([c[k] for c, k in zip(self.codebooks, codes)], 1) / SCALE

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for c in self.codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def _sums(vectors: DataFrame, codes: VectorCodes) -> dict[int, int]:
    """For each part, entry and place within the part (or, behind the places, the count): the sum over assigned parts."""
    wide, entries = max(c.shape[1] for c in codes.codebooks) + 1, len(codes.codebooks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(totals: np.ndarray) -> pa.RecordBatch:
            flat = totals.ravel()
            used = np.flatnonzero(flat)
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(flat[used], pa.int64())], names=["slot", "total"])

        totals, held = np.zeros((len(codes.codebooks), entries, wide), np.int64), 0
        for batch in batches:
            _, values = integer_vectors(batch["embedding"], codes.size)
            found, _ = codes.assign(values)
            for p, (a, b) in enumerate(zip(codes.at, codes.at[1:])):
                order = np.argsort(found[p], kind="stable")
                used, first, counts = np.unique(found[p][order], return_index=True, return_counts=True)
                if len(used):
                    totals[p, used, wide - 1] += counts
                    if b > a:
                        totals[p, used, : b - a] += np.add.reduceat(values[order, a:b], first)
            held += len(values)
            if held >= FLUSH_ROWS:
                yield table(totals)
                totals[:], held = 0, 0
        yield table(totals)

    added = map_arrow(vectors, run, "slot long, total long").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {r["slot"]: int(r["total"]) for r in added.collect()}


def refine(vectors: DataFrame, codes: VectorCodes) -> VectorCodes:
    """One round: assign every part, then replace each used entry by the floored mean of its parts."""
    sums, wide, entries = _sums(vectors, codes), max(c.shape[1] for c in codes.codebooks) + 1, len(codes.codebooks[0])
    out = []
    for p, book in enumerate(codes.codebooks):
        new = book.copy()
        for e in range(entries):
            base = (p * entries + e) * wide
            if count := sums.get(base + wide - 1, 0):
                new[e] = [sums.get(base + i, 0) // count for i in range(book.shape[1])]
        out.append(new)
    return VectorCodes(out)


def usable(column: str = "embedding") -> Column:
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def fit(rows: DataFrame, size: int, rounds: int = ROUNDS) -> VectorCodes:
    """Codebooks for the vectors of one length."""
    first = rows.where(usable() & (F.size("embedding") == size)).select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    start = pa.array([r["embedding"] for r in first], pa.list_(pa.float64()))
    codes = VectorCodes.starting(integer_vectors(start, size)[1])
    for _ in range(rounds):
        codes = refine(rows.select("embedding"), codes)
    return codes


def encode(rows: DataFrame, codes: VectorCodes) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for each part) and error of the usable rows of the codebooks' length."""
    schema = StructType([StructField("vec_id", rows.schema["vec_id"].dataType), StructField("label", rows.schema["label"].dataType), StructField("code", StringType()), StructField("error", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = integer_vectors(batch["embedding"], codes.size)
            found, errors = codes.assign(values)
            text = found.T.astype(np.uint8).tobytes().hex()
            step = 2 * len(codes.codebooks)
            kept = batch.take(pa.array(at))
            written = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
            yield pa.RecordBatch.from_arrays([kept["vec_id"], kept["label"], written, pa.array([min(e, LONGEST) for e in errors], pa.int64())], names=schema.names)

    return map_arrow(rows.select("vec_id", "label", "embedding"), run, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over equal labels, nulls together.

    Labels with many rows are few and are broadcast; the others are joined by their hash.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    rows = sums.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy, light = sums.where(F.col("n") * HEAVY_LABELS >= rows).drop("n"), sums.where(F.col("n") * HEAVY_LABELS < rows).drop("n")
    same = coded["label"].eqNullSafe(F.col("of"))
    often = coded.join(F.broadcast(heavy), same).drop("of")
    return often.unionByName(coded.join(F.broadcast(heavy), same, "left_anti").join(light, same).drop("of"))


def compress(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row."""
    sizes = [r["size"] for r in rows.where(usable()).groupBy(F.size("embedding").alias("size")).count().orderBy("size").collect()]
    coded = None
    for size in sizes:
        codes = fit(rows, size, rounds)
        own = encode(rows, codes).withColumn("codebooks_sha256", F.lit(codes.sha256()))
        coded = own if coded is None else coded.unionByName(own)
    if coded is None:
        fields = [StructField("vec_id", rows.schema["vec_id"].dataType), StructField("code", StringType()), StructField("error", LongType()), StructField("label_error", LongType()), StructField("codebooks_sha256", StringType())]
        return empty_frame(rows, StructType(fields))
    return with_label_error(materialize(coded, "vector-codes")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The rounds as a chain of common table expressions; vectors whose length four divides, all of one length, as the given ones."""
    nearest = lambda r: f"""a{r} AS MATERIALIZED (SELECT vec_id, label, part, v, min(struct_pack(d := d, entry := entry)) AS best FROM (
  SELECT p.vec_id, p.label, p.part, p.v, c.entry, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS d FROM parts p JOIN c{r} c USING (part)) GROUP BY ALL)"""  # noqa: E731
    steps = [f"c0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))"]
    for r in range(ROUNDS):
        steps += [nearest(r), f"""m{r} AS MATERIALIZED (SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS v FROM (
  SELECT part, best.entry AS entry, i, CAST(sum(v[i]) AS DOUBLE) AS total, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY part, entry)""",
            f"c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (part, entry))"]
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) r(part)),
{(','+chr(10)).join(steps)},
{nearest(ROUNDS)},
coded AS (SELECT vec_id, label, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


ORACLE_SQL = _sql()
