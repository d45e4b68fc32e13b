"""Simple-8b: word-aligned coding of unsigned integers.

The top four bits of a 64-bit word select how many values of which width it
holds.  Selector 0 is an escape: the next word is one raw value of more than 60
bits.  No word reaches over a block's end, so a block can be decoded from its
word offset alone.  Coding and decoding work on whole arrays.
"""

from __future__ import annotations

import numpy as np

#: Fixed values: (values, bits each) of selectors 1 to 15; selector 0 is the escape.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 0
BLOCK = 512
_COUNT = np.array([1, *(n for n, _ in SELECTORS)], np.int64)
_POWERS = np.array([1 << b for b in range(64)], np.uint64)


_SHORT_BITS = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    if values.max() < 1 << 16:
        return _SHORT_BITS[values.astype(np.uint16)]
    return np.searchsorted(_POWERS, values, side="right").astype(np.uint8)


def _window_max(bits: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size the maximum over the window that starts at each position; windows are cut at the array's end."""
    doubled, out = {1: bits}, {}
    for size in sizes:
        half = 1
        while half * 2 <= size:
            if half * 2 not in doubled:
                wide = doubled[half].copy()
                np.maximum(wide[:-half], doubled[half][half:], out=wide[:-half]) if len(wide) > half else None
                doubled[half * 2] = wide
            half *= 2
        wide, shift = doubled[half].copy(), size - half
        if shift and len(wide) > shift:
            np.maximum(wide[:-shift], doubled[half][shift:], out=wide[:-shift])
        out[size] = wide
    return out


def encode(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encode rows of values, ``lengths`` values each, in blocks of at most ``BLOCK``.

    Returns the words, each row's number of words, and each block's number of
    words (blocks in order of rows; a row of n values has ceil(n / BLOCK) blocks).
    """
    values, lengths = np.asarray(values, np.uint64), np.asarray(lengths, np.int64)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    row_start = np.cumsum(lengths) - lengths
    start = row_start[owner] + nth * BLOCK
    end = np.minimum(start + BLOCK, row_start[owner] + lengths[owner])
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64), np.zeros(0, np.int64)
    bits = _bits(values)
    left = np.minimum(np.repeat(end, end - start) - np.arange(len(values)), 255).astype(np.uint8)
    best = np.zeros(len(values), np.uint8)
    widest = _window_max(bits, [n for n, _ in SELECTORS])
    for selector in range(len(SELECTORS), 0, -1):
        n, width = SELECTORS[selector - 1]
        best[(widest[n] <= width) & (left >= n)] = selector
    at, active, step = start.copy(), np.arange(len(start)), 0
    seen_block, seen_at, seen_word = [], [], []
    used = np.zeros(len(start), np.int64)
    while len(active):
        here = at[active]
        chosen = best[here]
        seen_block.append(active)
        seen_at.append(here)
        seen_word.append(used[active])
        used[active] += np.where(chosen == ESCAPE, 2, 1)
        at[active] = here + _COUNT[chosen]
        active = active[at[active] < end[active]]
        step += 1
    base = np.cumsum(used) - used
    block, here = np.concatenate(seen_block), np.concatenate(seen_at)
    place = base[block] + np.concatenate(seen_word)
    words = np.zeros(int(used.sum()), np.uint64)
    chosen = best[here]
    for selector in np.unique(chosen).tolist():
        mine = chosen == selector
        first, to = here[mine], place[mine]
        if selector == ESCAPE:
            words[to + 1] = values[first]
            continue
        n, width = SELECTORS[selector - 1]
        packed = np.full(len(first), selector << 60, np.uint64)
        if width:
            for k in range(n):
                packed |= values[first + k] << np.uint64(k * width)
        words[to] = packed
    row_words = np.zeros(len(lengths), np.int64)
    np.add.at(row_words, owner, used)
    return words, row_words, used


def block_lengths(lengths: np.ndarray) -> np.ndarray:
    """The number of values in every block of rows of these lengths."""
    lengths = np.asarray(lengths, np.int64)
    blocks = -(-lengths // BLOCK)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.minimum(BLOCK, np.repeat(lengths, blocks) - nth * BLOCK)


def decode_blocks(words: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All values of blocks that begin at ascending word offsets; each must hold as many values as ``lengths`` says."""
    count = _counts(words)
    held = np.add.reduceat(count, offsets) if len(offsets) else np.zeros(0, np.int64)
    if not np.array_equal(held, lengths):
        raise ValueError("a block does not hold as many values as its row says")
    return decode(words)


def decode_range(words: np.ndarray, offsets: np.ndarray, n: int, first: int, stop: int) -> np.ndarray:
    """Values ``first`` to ``stop`` (exclusive) of a row of ``n`` values; only the blocks that hold them are decoded."""
    first, stop = max(0, first), min(n, stop)
    if first >= stop:
        return np.zeros(0, np.uint64)
    a, b = first // BLOCK, -(-stop // BLOCK)
    held = decode(words[offsets[a] : offsets[b] if b < len(offsets) else len(words)])
    return held[first - a * BLOCK : stop - a * BLOCK]


def _counts(words: np.ndarray) -> np.ndarray:
    """The number of values in every word; 0 for an escape's raw value, whatever its top bits are."""
    selector = (np.asarray(words, np.uint64) >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(selector), bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    return np.where(raw, 0, _COUNT[selector])


def decode(words: np.ndarray) -> np.ndarray:
    """All values of consecutive whole blocks."""
    words = np.asarray(words, np.uint64)
    count = _counts(words)
    selector = np.where(count == 0, -1, (words >> np.uint64(60)).astype(np.int64))
    to = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(selector[selector >= 0]).tolist():
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[to[mine]] = words[mine + 1]
            continue
        n, width = SELECTORS[s - 1]
        if width:
            mask = np.uint64((1 << width) - 1)
            for k in range(n):
                out[to[mine] + k] = (words[mine] >> np.uint64(k * width)) & mask
    return out
