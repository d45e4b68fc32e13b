"""Ids of a word-level tokenizer, with a bounded cache of the library's results.

The tokenizer drops white space and never joins across it, so the ids of a text
are those of its chunks between spaces.  A chunk of plain letters with
punctuation behind them is put together from these two parts.  New parts of
plain letters are one word to the tokenizer, so they go to the library's model
as its own normalizer and pre-tokenizer would hand them over; these are asked
once for every letter.  Other new parts of a slice of texts go through the whole
tokenizer in few calls, set apart by a control character that has an id of its own.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rasterloom.llm.chunks import LOWER_LETTERS, chunk_table, gather, join_parts, part_table
from rasterloom.llm.common import held

CACHED_PARTS = 250_000
#: Longer parts are not kept.
KEPT_CHARS = 64
#: U+0001 stands between parts that are encoded in one call.
SEPARATOR = "\x01"
CALL_PARTS = 500


class WordTokens:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        found = self.library.encode(SEPARATOR, add_special_tokens=False).ids
        self._mark = found[0] if len(found) == 1 else None
        self._model = self.library.model
        self._spelling = self._spellings()
        self._known: dict[str, bytes] = {"": b""}

    def _spellings(self) -> dict[int, str] | None:
        """What the model gets for each plain letter; None where a run of letters is not one word, letter by letter."""

        def words(text: str) -> list[str]:
            if self.library.normalizer is not None:
                text = self.library.normalizer.normalize_str(text)
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

        if self.library.pre_tokenizer is None:
            return None
        own = {c: words(c) for c in LOWER_LETTERS}
        if any(len(w) != 1 for w in own.values()):
            return None
        for run in (LOWER_LETTERS, LOWER_LETTERS[::-1]):
            if words(run) != ["".join(own[c][0] for c in run)]:
                return None
        return {ord(c): w for c, (w,) in own.items()}

    def _encode_letters(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words of plain letters."""
        if self._spelling is None:
            return self._encode_new(words)
        tokenize, spelling = self._model.tokenize, self._spelling
        coded = [[t.id for t in tokenize(w if w.isascii() else w.translate(spelling))] for w in words]
        raw = np.array([i for ids in coded for i in ids], np.uint32).tobytes()
        out, at = {}, 0
        for word, ids in zip(words, coded):
            end = at + 4 * len(ids)
            out[word] = raw[at:end]
            at = end
        return out

    def _direct(self, part: str) -> bytes:
        return np.asarray(self.library.encode(part, add_special_tokens=False).ids, np.uint32).tobytes()

    def _encode_new(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of distinct parts without spaces."""
        out = {p: self._direct(p) for p in parts if len(p) > KEPT_CHARS or SEPARATOR in p or self._mark is None}
        short = [p for p in parts if p not in out]
        calls = [short[i : i + CALL_PARTS] for i in range(0, len(short), CALL_PARTS)]
        coded = self.library.encode_batch_fast([f" {SEPARATOR} ".join(c) for c in calls], add_special_tokens=False)
        for call, encoding in zip(calls, coded, strict=True):
            ids = np.asarray(encoding.ids, np.uint32)
            ends = np.flatnonzero(ids == self._mark)
            if len(ends) != len(call) - 1:
                out.update((p, self._direct(p)) for p in call)
                continue
            raw, cuts = ids.tobytes(), [-4, *(ends * 4).tolist(), 4 * len(ids)]
            out.update((part, raw[cuts[i] + 4 : cuts[i + 1]]) for i, part in enumerate(call))
        return out

    def encode_parts(self, parts: list[str], letters: int = 0) -> list[bytes]:
        """The ids of distinct parts, of which the first ``letters`` are words of plain small letters."""
        known = self._known
        out = list(map(known.get, parts))
        if None in out:
            new = self._encode_letters([p for p, ids in zip(parts[:letters], out) if ids is None])
            new |= self._encode_new([p for p, ids in zip(parts[letters:], out[letters:]) if ids is None])
            if len(known) + len(new) > CACHED_PARTS:
                known.clear()
                known[""] = b""
            known.update((p, ids) for p, ids in new.items() if len(p) <= KEPT_CHARS)
            out = [ids if ids is not None else new[p] for p, ids in zip(parts, out)]
        return out

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit), and each text's number of ids; a null text counts as empty."""
        # line ends are white space like spaces
        chunks, codes, offsets = chunk_table(pc.replace_substring(texts, "\n", " "))
        parts = part_table(chunks, lower=True)
        ids = self.encode_parts([*parts.letters, *parts.marks, *parts.others, ""], len(parts.letters))
        return gather(ids, join_parts(parts, codes, len(ids) - 1), 2 * offsets)


def word_tokens(path: str) -> WordTokens:
    """The worker's tokenizer."""
    return held(("word tokens", path), lambda: WordTokens(path))


def ended_ids(tokens: WordTokens, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids with ``end_id`` behind each text's, and each text's number of ids with it."""
    ids, counts = tokens.encode_texts(texts)
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
