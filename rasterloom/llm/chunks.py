"""Texts as codes of their distinct chunks between spaces, so that Python sees each chunk of a slice once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Letters that are one code point each in either case and in composed form, then ASCII punctuation.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Those letters, each in its small form.
LOWER_LETTERS = "".join(chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x100)) if c != 0xF7)
MARKS = r"!-/:-@\[-`{-~"


class ChunkTable(NamedTuple):
    chunks: pa.Array  # distinct
    codes: np.ndarray  # of all chunks of all texts
    offsets: np.ndarray  # of each text in codes, and the end


class PartTable(NamedTuple):
    """Each distinct chunk as up to two parts: letters and the punctuation behind them, or the chunk itself."""

    letters: list[str]
    marks: list[str]
    others: list[str]
    first: np.ndarray  # each chunk's first part in letters + marks + others
    second: np.ndarray  # its second part, or -1


def chunk_table(texts: pa.Array) -> ChunkTable:
    """Chunks of every text; null texts count as empty and have one empty chunk."""
    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    return ChunkTable(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy())


def part_table(chunks: pa.Array, marks: str = MARKS, lower: bool = False) -> PartTable:
    """Split distinct chunks; only those of plain letters with the given marks behind them have parts."""
    found = pc.extract_regex(chunks, f"^(?P<letters>[{LETTERS}]+)(?P<marks>[{marks}]*)$")
    plain = found.is_valid()
    letters = found.field("letters").filter(plain)
    letters = (pc.utf8_lower(letters) if lower else letters).dictionary_encode()
    ends = found.field("marks").filter(plain).dictionary_encode()
    at = plain.to_numpy(zero_copy_only=False)
    end_names = ends.dictionary.to_pylist()
    names = letters.dictionary.to_numpy(zero_copy_only=False).tolist()
    n, m = len(names), len(end_names)
    first, second = np.empty(len(chunks), np.int64), np.full(len(chunks), -1, np.int64)
    first[at] = letters.indices.to_numpy(zero_copy_only=False)
    own = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64) + n
    second[at] = np.where(own - n == (end_names.index("") if "" in end_names else -1), -1, own)
    first[~at] = n + m + np.arange(int((~at).sum()))
    return PartTable(names, end_names, chunks.filter(pc.invert(plain)).to_pylist(), first, second)


def join_parts(table: PartTable, codes: np.ndarray, empty: int) -> np.ndarray:
    """The part numbers of all chunks, two for each; ``empty`` stands for none."""
    out = np.empty(2 * len(codes), np.int64)
    out[::2] = table.first[codes]
    second = table.second[codes]
    out[1::2] = np.where(second < 0, empty, second)
    return out


def gather(parts: list[bytes], codes: np.ndarray, offsets: np.ndarray, dtype: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """Put the coded parts (arrays as bytes) together: all values, and each text's number of values."""
    flat = np.frombuffer(b"".join(parts), dtype)
    size = np.array([len(p) for p in parts], np.int64) // np.dtype(dtype).itemsize
    first = np.cumsum(size) - size
    counts = size[codes]
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first[codes] - ends[:-1], counts) + np.arange(ends[-1])
    return flat[at], np.diff(ends[offsets])


class IntTable:
    """A hash table of non-negative 64-bit integers in arrays, for whole arrays of keys; missing keys give -1."""

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)

    @property
    def full(self) -> bool:
        return 2 * self.used > len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at, out, mask = self._slots(keys), np.empty(len(keys), np.int32), len(self.keys) - 1
        found = self.keys[at]
        out[:] = self.values[at]
        rest = np.flatnonzero(found != keys)
        while len(rest):
            missing = self.keys[at[rest]] < 0
            out[rest[missing]] = -1
            rest = rest[~missing]
            at[rest] = (at[rest] + 1) & mask
            hit = self.keys[at[rest]] == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not in the table."""
        at, mask, rest = self._slots(keys), len(self.keys) - 1, np.arange(len(keys))
        self.used += len(keys)
        while len(rest):
            free = rest[self.keys[at[rest]] < 0]
            slots, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            rest = np.setdiff1d(rest, placed, assume_unique=True)
            at[rest] = (at[rest] + 1) & mask
