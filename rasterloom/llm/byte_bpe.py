"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end the
prefix's BPE encoding.  A :class:`PrefixTable` stores that token for each
prefix.  Position ``i`` takes the one vocabulary token ``t`` that ends at ``i``
and stands validly after the token stored for ``i - len(t)``; two tokens are a
valid pair if BPE applied to their joined bytes gives back the two of them.
Appends only add positions.  An edit keeps the positions before it, recomputes
those behind it and stops as soon as the stored tokens agree with the old ones
over as many positions as the longest token has bytes.

Texts are split by the tokenizer's pattern first.  As no match spans a single
space that stands between two visible characters, whole chunks between such
spaces are encoded once and kept in a bounded cache.

Defined cases: a null text counts as empty; an empty text has no ids; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from rasterloom.llm.chunks import IntTable, chunk_table, gather, join_parts, part_table
from rasterloom.llm.common import batch_slices, held, map_arrow

#: White space beside a space, or of another kind than the space and the newline; such texts are split by the pattern as a whole.
_OTHER_SPACE = "\\t\\r\\x0b\\x0c\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
MIXED_SPACE = rf" [ \n]|\n |[{_OTHER_SPACE}]"
#: ASCII punctuation but the apostrophe, which may begin a piece of its own.
BPE_MARKS = r"!-&(-/:-@\\[-`{-~"
CACHED_PIECES = 450_000
PAIR_TABLE_BITS = 20
BATCH_PIECES = 40_000
BATCH_BYTES = 256
CACHED_PAIRS = 300_000


class Vocabulary:
    """Mergeable ranks with the checks that the dynamic programme needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.raw = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.trie: dict = {}
        for token, i in ranks.items():
            node = self.trie
            for byte in token:
                node = node.setdefault(byte, {})
            node[-1] = i
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[int, list[tuple[bytes, float]]] = {}
        self.pairs: dict[int, bool] = {}
        self.width = max(ranks.values()) + 1

    def merge(self, data: bytes) -> tuple[list[int], int]:
        """Plain BPE on a short byte string: join the adjacent pair of lowest rank until none can be joined.

        Returns the tokens and the length of the left part of the last join.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        get, worst, left = self.rank.get, len(self.rank) + 1, 0
        while len(parts) > 1:
            ranks = [get(a + b, worst) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == worst:
                break
            at = ranks.index(best)
            left = len(parts[at])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts], left

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join makes this one; None for a byte, and for a token that BPE never makes of its own bytes."""
        try:
            return self._parts[token]
        except KeyError:
            raw = self.raw[token]
            ids, left = self.merge(raw)
            made = (self.rank[raw[:left]], self.rank[raw[left:]]) if len(raw) > 1 and ids == [token] else None
            self._parts[token] = made
            return made

    def alone(self, token: int) -> bool:
        """Whether BPE of the token's own bytes gives the token."""
        return len(self.raw[token]) == 1 or self.parts(token) is not None

    def edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's left (0) or right (1) edge while BPE makes it: each part's bytes, and the rank of the join that ends it."""
        key = 2 * token + side
        known = self._edges.get(key)
        if known is None:
            known, at, ends = [], token, float("inf")
            while True:
                known.append((self.raw[at], ends))
                made = self.parts(at)
                if made is None:
                    break
                at, ends = made[side], at
            known.reverse()
            self._edges[key] = known
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined bytes gives just the two tokens.

        Both sides of the boundary are followed in the order of the joins: the
        two tokens stand if no two parts that meet there would be joined before
        either of them is absorbed by its own side.  Of joins with equal rank
        the one further left is made first.
        """
        if not (self.alone(left) and self.alone(right)):
            return False
        ours, theirs, get = self.edge(left, 1), self.edge(right, 0), self.rank.get
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = ours[i], theirs[j]
            joined = get(a + b)
            if joined is not None and joined < a_ends and joined <= b_ends:
                return False
            if i + 1 == len(ours) and j + 1 == len(theirs):
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The last token of every prefix of ``data``; ``last[0]`` is unused."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _walk(self, data: bytes, last: list[int], start: int, begin: int) -> None:
        """Give every prefix that a token can extend from ``begin`` its last token, if the token may follow there and ends behind ``start``."""
        v = self.vocabulary
        node, end, before = v.trie, begin, last[begin]
        pairs, base = v.pairs, before * v.width
        for byte in data[begin : begin + v.longest]:
            node = node.get(byte)
            if node is None:
                return
            end += 1
            token = node.get(-1)
            if token is None or end <= start or last[end] >= 0:
                continue
            if begin == 0:
                fits = v.alone(token)
            else:
                fits = pairs.get(base + token)
                if fits is None:
                    if len(pairs) >= CACHED_PAIRS:
                        pairs.clear()
                    fits = pairs[base + token] = v.follows(before, token)
            if fits:
                last[end] = token

    def append(self, more: bytes) -> None:
        old, data, last = len(self.data), self.data + more, self.last
        last.extend([-1] * len(more))
        for begin in range(max(0, old - self.vocabulary.longest + 1), len(data)):
            self._walk(data, last, old, begin)
        self.data = data

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of ``data[start:stop]``; returns how many positions were computed."""
        old, shift, longest = self.last, len(new) - (stop - start), self.vocabulary.longest
        data = self.data[:start] + new + self.data[stop:]
        last, same = old[: start + 1] + [-1] * (len(data) - start), 0
        for begin in range(max(0, start - longest + 1), len(data)):
            if begin > start + len(new):
                same = same + 1 if old[begin - shift] == last[begin] else 0
                if same >= longest:
                    last[begin + 1 :] = old[begin - shift + 1 :]
                    self.data, self.last = data, last
                    return begin - start
            self._walk(data, last, start, begin)
        self.data, self.last = data, last
        return len(data) - start

    def ids(self) -> list[int]:
        out, end, raw = [], len(self.data), self.vocabulary.raw
        while end:
            if self.last[end] < 0:
                raise ValueError("the vocabulary does not cover these bytes")
            out.append(self.last[end])
            end -= len(raw[self.last[end]])
        return out[::-1]


class PrefixBatch:
    """The prefix tables of many pieces at once: position by position, for all pieces together."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        nodes, edges, tokens = [vocabulary.trie], [], []
        for number, node in enumerate(nodes):
            tokens.append(node.get(-1, -1))
            for byte, child in node.items():
                if byte >= 0:
                    edges.append((number << 8 | byte, len(nodes)))
                    nodes.append(child)
        self.token = np.array(tokens, np.int32)
        self.next = IntTable(max(4, (3 * len(edges)).bit_length()))
        self.next.put(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int32))
        self.length = np.zeros(vocabulary.width, np.int64)
        for raw, i in vocabulary.rank.items():
            self.length[i] = len(raw)
        self.pairs = IntTable(PAIR_TABLE_BITS)

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each right token may follow the left one (-2: the piece's start)."""
        v = self.vocabulary
        keys = (left.astype(np.int64) + 2) * v.width + right
        known = self.pairs.get(keys)
        new = np.unique(keys[known < 0])
        if len(new):
            if self.pairs.full:
                self.pairs = IntTable(PAIR_TABLE_BITS)
            checked = [v.alone(k) if a == 0 else v.follows(a - 2, k) for a, k in (divmod(key, v.width) for key in new.tolist())]
            self.pairs.put(new, np.array(checked, np.int32))
            known = np.where(known < 0, np.array(checked, np.int32)[np.minimum(np.searchsorted(new, keys), len(new) - 1)], known)
        return known > 0

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian unsigned 32-bit integers."""
        size = np.array(list(map(len, pieces)), np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        number = np.repeat(np.arange(len(pieces)), size)
        stop = (begin + size)[number]
        # all tokens that stand anywhere in the pieces
        start, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        starts, ends, tokens = [], [], []
        while len(start):
            node = self.next.get(node << 8 | data[start + depth])
            alive = node >= 0
            start, node = start[alive], node[alive].astype(np.int64)
            depth += 1
            token = self.token[node]
            ending = token >= 0
            starts.append(start[ending])
            ends.append(start[ending] + depth)
            tokens.append(token[ending])
            going = start + depth < stop[start]
            start, node = start[going], node[going]
        start, end, token = np.concatenate(starts), np.concatenate(ends), np.concatenate(tokens)
        owner = number[start]
        order = np.argsort(end - begin[owner], kind="stable")
        start, token, owner = start[order], token[order], owner[order]
        reached = end[order] - begin[owner]
        # prefix k of piece i is state begin[i] + i + k
        before, after = start + owner, begin[owner] + owner + reached
        last = np.full(len(data) + len(pieces), -1, np.int32)
        last[begin + np.arange(len(pieces))] = -2
        cuts = np.searchsorted(reached, np.arange(1, (int(size.max()) if len(size) else 0) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            left = last[before[a:b]]
            good = np.flatnonzero(self._fits(left, token[a:b]) & (left != -1))
            last[after[a:b][good]] = token[a:b][good]
        # back from the ends
        state, pending, step = begin + np.arange(len(pieces)) + size, np.flatnonzero(size), 0
        owners, steps, out = [], [], []
        while len(pending):
            token = last[state[pending]]
            if len(token) and token.min() < 0:
                raise ValueError("the vocabulary does not cover these bytes")
            owners.append(pending)
            out.append(token)
            steps.append(np.full(len(pending), step))
            state[pending] -= self.length[token]
            pending = pending[last[state[pending]] != -2]
            step += 1
        if not owners:
            return [b""] * len(pieces)
        owner, step_of, token = np.concatenate(owners), np.concatenate(steps), np.concatenate(out)
        count = np.bincount(owner, minlength=len(pieces))
        stops = np.cumsum(count)
        ids = np.empty(len(token), "<u4")
        ids[stops[owner] - 1 - step_of] = token
        raw = ids.tobytes()
        return [raw[4 * (e - n) : 4 * e] for e, n in zip(stops.tolist(), count.tolist())]


class ByteBpe:
    """Encodes and decodes texts; one instance lives in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.batch = PrefixBatch(self.vocabulary)
        self.split = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}
        self.raw_size = self.batch.length
        self.decimal = [str(i) for i in range(self.vocabulary.width)]

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        out, new, longer = {}, [], []
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.vocabulary.rank.get(data)
            if not data:
                out[piece] = b""
            elif whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(data) > BATCH_BYTES:
                longer.append((piece, data))
            else:
                new.append((piece, data))
        for piece, data in longer:
            out[piece] = np.array(PrefixTable(self.vocabulary, data).ids(), "<u4").tobytes()
        for at in range(0, len(new), BATCH_PIECES):
            some = new[at : at + BATCH_PIECES]
            out.update(zip([p for p, _ in some], self.batch.encode([d for _, d in some]), strict=True))
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as bytes; new pieces are encoded together."""
        known = self._known
        out = list(map(known.get, pieces))
        if None in out:
            new = [p for p, ids in zip(pieces, out) if ids is None]
            if len(known) + len(new) > CACHED_PIECES:
                known.clear()
            known.update(self._encode_pieces(new))
            out = [ids if ids is not None else known[p] for p, ids in zip(pieces, out)]
        return out

    def encode_pieces_of(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that the pattern splits one by one."""
        split = list(map(self.split, texts))
        pieces = list({p for own in split for p in own})
        ids = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        return [b"".join(map(ids.__getitem__, own)) for own in split]

    def encode_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; a null text counts as empty."""
        texts = pc.fill_null(texts, "")
        mixed = pc.match_substring_regex(texts, MIXED_SPACE).to_numpy(zero_copy_only=False)
        chunks, codes, offsets = chunk_table(pc.if_else(pa.array(mixed), "", texts))
        # the first chunk of each text has no space before it
        heads = chunks.take(pa.array(codes[offsets[:-1]])).dictionary_encode()
        parts = part_table(chunks, BPE_MARKS)
        n = len(parts.letters) + len(parts.marks) + len(parts.others)
        ids = [
            *self.encode_pieces([" " + p for p in parts.letters] + parts.marks), *self.encode_pieces_of([" " + c for c in parts.others]),
            b"", *self.encode_pieces_of(heads.dictionary.to_pylist()),
        ]
        numbers = join_parts(parts, codes, n)
        at = 2 * offsets[:-1]
        numbers[at], numbers[at + 1] = n + 1 + heads.indices.to_numpy(), n
        flat, counts = gather(ids, numbers, 2 * offsets)
        out = np.split(flat, np.cumsum(counts)[:-1])
        whole = np.flatnonzero(mixed).tolist()
        for i, own in zip(whole, self.encode_pieces_of([texts[i].as_py() for i in whole]), strict=True):
            out[i] = np.frombuffer(own, "<u4")
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.raw.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def codec(path: str, pattern: str) -> ByteBpe:
    """The worker's codec."""
    return held(("byte bpe", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))


def map_ids(df: DataFrame, ranks_path: str, pattern: str, finish: Callable[[ByteBpe, list[int]], tuple], fields: list[StructField]) -> DataFrame:
    """Encode every text and return doc_id with what ``finish(codec, ids)`` makes of its ids, in the Python worker."""
    schema = StructType([StructField("doc_id", df.schema["doc_id"].dataType), *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        bpe, arrow = codec(ranks_path, pattern), to_arrow_schema(schema)
        for part in batch_slices(batches):
            rows = [finish(bpe, ids.tolist()) for ids in bpe.encode_texts(part["text"])]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(arrow.field(0).type), *(pa.array(list(c), arrow.field(i + 1).type) for i, c in enumerate(columns))], schema=arrow)

    return map_arrow(df.select("doc_id", "text"), run, schema)


def encode_documents(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    return map_ids(df, ranks_path, pattern, lambda bpe, ids: (ids,), [StructField("ids", ArrayType(IntegerType(), False))])


def decode_ids(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of every row of doc_id and ids (null ids: empty)."""
    schema = StructType([StructField("doc_id", df.schema["doc_id"].dataType), StructField("data", BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        bpe, arrow = codec(ranks_path, pattern), to_arrow_schema(schema)
        for batch in batches:
            data = [bpe.decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(arrow.field(0).type), pa.array(data, pa.binary())], schema=arrow)

    return map_arrow(df.select("doc_id", "ids"), run, schema)
