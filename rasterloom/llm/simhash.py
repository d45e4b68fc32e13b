"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is set if over half the hashes of the text's shingles have
it.  Equal fingerprints are joined at once.  For a radius r, 2^(r+1) - 1 masks
are built from a random code word of r + 1 bits per bit position: mask v holds
the positions whose word has an odd overlap with v.  For any r differing
positions some v is orthogonal to all their words, so each pair within the
radius agrees under some mask and meets in that mask's table.

The tables' rows are brought together by (mask, masked bits) and read in order;
what meets is compared in the task and leaves it as a spanning forest, one edge
per fingerprint at most.  Meetings of more than ``SPLIT_MOST`` fingerprints pass
through their task unread and are dealt anew: a second covering family over the
positions that the first mask leaves free cuts each into many.  What then meets
agrees in all but some 16 positions, so no meeting exceeds 2 to the number of
these.  Meetings of over ``PAIRWISE_MOST`` are joined over common neighbours: two
fingerprints within r = 2k of each other have one within k of both, so sorting
all such neighbours finds their connections; to bound memory these are
enumerated once for every 3000 fingerprints of the meeting.

Defined cases: a null or wordless text has fingerprint zero and is linked like
any other; texts with fewer words than a shingle have one shingle of all their
words; repeated rows share their component; documents with a null id are given
back with their fingerprint and the smallest id of their component (null if the
component has no ids); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rasterloom.llm.common import map_arrow, release_held, text_slices
from rasterloom.llm.components import connected_components, join_classes, union_find
from rasterloom.session import materialize

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
#: Meetings of more fingerprints than this are joined over common neighbours instead of pair by pair.
PAIRWISE_MOST = 1500
#: Meetings of more fingerprints than this are dealt anew by a second family of masks.
SPLIT_MOST = 6000
#: Fingerprints that only rows without an id have are numbered from here on, above all ids.
NAMELESS = 1 << 62
_SPREAD = np.uint64(0x0101010101010101)


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 20240229) -> list[int]:
    """2^(radius + 1) - 1 masks such that any ``radius`` positions are all outside some mask."""
    codes = np.random.default_rng(seed).integers(1, 1 << (radius + 1), bits).tolist()
    return [sum(1 << i for i, code in enumerate(codes) if (code & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of ``lengths`` hashes; rows without hashes get zero."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    length = lengths[full]
    start = np.cumsum(length) - length
    blocks = -(-length // 255)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    cuts, first = np.repeat(start, blocks) + 255 * nth, np.cumsum(blocks) - blocks
    for shift in range(8):
        # eight counters of eight bits in each word: bits shift, shift + 8, ...
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & _SPREAD, cuts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > length).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        release_held()
        arrow = to_arrow_schema(schema)
        for part, texts in text_slices(batches):
            hashes = [shingle_hashes(t) for t in texts]
            lengths = np.array([len(h) for h in hashes], np.int64)
            flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(lengths.sum()))
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(arrow.field(0).type), pa.array(majority_bits(flat, lengths).view(np.int64))], schema=arrow)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def _pairwise(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    for at in range(0, len(prints), 256):
        rows = prints[at : at + 256]
        near = np.bitwise_count(rows[:, None] ^ prints[None, at:]) <= radius
        a, b = np.nonzero(near)
        keep = a < b
        left.append(a[keep] + at)
        right.append(b[keep] + at)
        if sum(map(len, left)) > 4 * len(prints):
            forest = union_find(np.concatenate(left).tolist(), np.concatenate(right).tolist())
            left, right = [np.array(list(forest.keys()), np.int64)], [np.array(list(forest.values()), np.int64)]
    return np.concatenate(left), np.concatenate(right)


def _over_neighbours(prints: np.ndarray, free: int, radius: int, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between prints that share a neighbour within half the (even) radius; positions outside ``free`` are equal in all of them."""
    positions = [i for i in range(64) if free >> i & 1]
    flips = np.array([sum(1 << i for i in chosen) for k in range(radius // 2 + 1) for chosen in combinations(positions, k)], np.uint64)
    left, right = [], []
    numbers = np.arange(len(prints))
    for piece in range(pieces):
        values, owners = [], []
        for flip in flips:
            near = prints ^ flip
            mine = (near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(pieces) == piece
            values.append(near[mine])
            owners.append(numbers[mine])
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        same = value[1:] == value[:-1]
        a, b = owner[1:][same], owner[:-1][same]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        forest = union_find(pairs[:, 0].tolist(), pairs[:, 1].tolist())
        left.append(np.array(list(forest.keys()), np.int64))
        right.append(np.array(list(forest.values()), np.int64))
    return np.concatenate(left), np.concatenate(right)


def spanning_edges(prints: np.ndarray, free: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A forest over distinct prints that agree outside ``free``: two are joined if links within the radius lead from one to the other."""
    if len(prints) <= PAIRWISE_MOST or radius % 2:
        left, right = _pairwise(prints, radius)
    else:
        left, right = _over_neighbours(prints, free, radius, max(1, len(prints) // 3000))
    return [(a, b) for a, b in union_find(left.tolist(), right.tolist()).items() if a != b]


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([part[c] for part in parts]) for c in parts[0]}


def _runs(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
    """Rows cut so that no meeting of equal (table, key) is split, and False; a meeting of over ``most`` rows comes in parts, and True."""
    held: list[dict[str, np.ndarray]] = []
    large = False
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch[c].to_numpy() for c in ("table", "key", "fp", "rep")}
        if held and (held[-1]["table"][-1] != now["table"][0] or held[-1]["key"][-1] != now["key"][0]):
            yield large, _joined(held)
            held, large = [], False
        last = (now["table"] == now["table"][-1]) & (now["key"] == now["key"][-1])
        cut = int(np.argmax(last))
        if cut:
            first = int(np.argmax(~((now["table"] == now["table"][0]) & (now["key"] == now["key"][0]))))
            if large:
                # the end of a large meeting
                yield True, _joined([*held, {c: v[:first] for c, v in now.items()}])
                if cut > first:
                    yield False, {c: v[first:cut] for c, v in now.items()}
            else:
                yield False, _joined([*held, {c: v[:cut] for c, v in now.items()}])
            held, large = [{c: v[cut:] for c, v in now.items()}], False
        else:
            held.append(now)
        if most is not None and sum(len(part["fp"]) for part in held) > most:
            yield True, _joined(held)
            held, large = [{c: v[-1:] for c, v in held[-1].items()}], True
    if held:
        yield large, _joined(held)


def _meetings(rows: DataFrame, masks: list[int], radius: int, most: int | None) -> DataFrame:
    """Edges (a, b) of the rows (table, key, fp, rep) that meet, and the rows (table, fp, rep) of meetings of over ``most``; ``masks`` are the tables'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large, now in _runs(batches, most):
            left, right = [], []
            if not large:
                new = np.concatenate([[True], (now["key"][1:] != now["key"][:-1]) | (now["table"][1:] != now["table"][:-1])])
                start = np.flatnonzero(new)
                size = np.diff(np.concatenate([start, [len(new)]]))
                over = np.repeat(size > most, size) if most is not None else np.zeros(len(new), bool)
                prints = now["fp"].view(np.uint64)
                two = start[size == 2]
                near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
                left.extend(now["rep"][near].tolist())
                right.extend(now["rep"][near + 1].tolist())
                for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                    if over[at]:
                        continue
                    free = ~masks[int(now["table"][at])] & ((1 << 64) - 1)
                    for a, b in spanning_edges(prints[at : at + n], free, radius):
                        left.append(int(now["rep"][at + a]))
                        right.append(int(now["rep"][at + b]))
                now = {c: v[over] for c, v in now.items()}
            none = pa.nulls(len(left), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), none.cast(pa.int32()), none, none], names=["a", "b", "table", "fp", "rep"])
            if len(now["fp"]):
                none = pa.nulls(len(now["fp"]), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(now["table"], pa.int32()), pa.array(now["fp"]), pa.array(now["rep"])], names=["a", "b", "table", "fp", "rep"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "table", "key").sortWithinPartitions("table", "key", "fp").mapInArrow(run, "a long, b long, table int, fp long, rep long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, radius: int = RADIUS, most: int = SPLIT_MOST) -> DataFrame:
    """Edges (a, b) between the reps of distinct fingerprints (fp, rep), spanning all links within the radius."""
    masks = covering_masks(radius)
    dealt = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = distinct.select("fp", "rep", dealt.alias("t")).select("t.table", "t.key", "fp", "rep")
    met = materialize(_meetings(rows, masks, radius, most), "meetings")
    edges = met.where("a is not null").select("a", "b")
    large = met.where("fp is not null").select("table", "fp", "rep").distinct()
    if large.isEmpty():
        return edges
    # within a table all agree under its mask: masks over the other positions, one family for each table
    finer = [m | (own & ~m) for i, m in enumerate(masks) for own in covering_masks(radius, seed=i)]
    all_masks = F.array(*[F.lit(_signed(m)) for m in finer])
    number = F.explode(F.sequence(F.col("table") * len(masks), F.col("table") * len(masks) + len(masks) - 1)).alias("finer")
    again = large.select("fp", "rep", number).select(F.col("finer").alias("table"), F.col("fp").bitwiseAND(F.element_at(all_masks, F.col("finer") + 1)).alias("key"), "fp", "rep")
    return edges.unionByName(_meetings(again, finer, radius, None).where("a is not null").select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    prints = materialize(fingerprints(docs), "fingerprints")
    nameless = F.lit(NAMELESS) + F.xxhash64("fp").bitwiseAND(F.lit(NAMELESS - 1))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("smallest"), F.count(F.lit(1)).alias("weight")).select("fp", F.coalesce("smallest", nameless).alias("rep"), "weight"), "prints")
    joined = materialize(connected_components(links(distinct.select("fp", "rep"), radius)), "components")
    named = F.coalesce("component", "rep")
    classes = distinct.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp", "weight", F.when(named < NAMELESS, named).alias("component_id"))
    classes = materialize(classes, "classes")
    return join_classes(prints.select("doc_id", "fp"), classes, ["fp"], prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` (all columns) with the smallest doc_id of their component.

    Of several rows with that doc_id one is kept, the smallest by its columns'
    hash.  As no id can stand for them, rows without a doc_id are kept once per
    distinct text.
    """
    names = docs.columns
    grouped = near_duplicates(docs.where("doc_id is not null"), radius)
    kept = docs.join(grouped.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), "doc_id", "left_semi").select(*names)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    columns = [F.col(f"`{n}`") for n in names]
    # maps cannot be hashed as they are
    hashed = [F.to_json(F.struct(c)) if "map<" in docs.schema[n].dataType.simpleString() else c for n, c in zip(names, columns)]
    smallest = F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias("row")
    several = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(smallest).select("row.*")
    nameless = docs.where("doc_id is null").groupBy(F.col("text").alias("same")).agg(smallest).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*names).unionByName(several).unionByName(nameless)
