"""Toxicity by noisy-channel deobfuscation.

Written text is taken as what a channel made of an intended one: letters turned
into look-alike digits and signs, repeated, or set apart by signs and spaces.
A stretch of chunks that may hold a disguise becomes one lattice: each run of
equal characters, spaces and signs included, may stand for several outputs.  A
Viterbi search under a character model (four-grams counted over all documents)
finds the likeliest intended text; the restored text is then scored by the
words that labelled documents show to be toxic.

The search keeps at most ``BEAM`` steps from one character to the next, the likeliest
contexts first, so its time grows with the length whatever the signs are.

What enters a lattice: chunks with digits, signs or repeated letters among their
characters, and runs of short chunks of which one is no usual word, with the
chunks beside them.  All other chunks stand for themselves, as any other reading
of them would be less likely.  A word of letters that is toxic as written stays
so, and words are learnt as they are written: only what holds a disguise is read
as another word.  Words of a stretch also count joined to their neighbours, so
that a gap left inside a spelt-out word hides nothing.  Letters are brought to
their compatible forms (full-width ones, say) and folded to a to z, so the model
has 28 ** 4 entries whatever the corpus; chunks with letters of other scripts are
taken as they are.

Labels are learnt from a bounded sample of labelled documents
(``SAMPLE_PER_CLASS`` per class, the smallest by a hash of doc_id); near copies
count once, and a word must occur in several unlike documents, so that a group's
own vocabulary is not taken for toxic words.

Defined cases: a null or empty text is scored like a text without toxic words;
texts of any length are read whole; repeated rows get equal scores; several
labels of a document count as toxic if one is, several texts of a labelled
doc_id count as the smallest; without labels of both classes all scores are 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from rasterloom.llm.chunks import chunk_table, part_table
from rasterloom.llm.common import BoundedCache, batch_slices, held, map_arrow, release_held
from rasterloom.session import materialize

SAMPLE_PER_CLASS = 3000
LEAST_DOCS = 5
#: A word of the lexicon is found in toxic documents that show so many different min-hashes under some seed.
LEAST_GROUPS = 4
#: Steps from the contexts before a run of characters to those behind it.
BEAM = 1024
#: Joined words of a stretch that may be one word.
MOST_JOINED = 4
CACHED_CHUNKS, CACHED_STRETCHES = 100_000, 50_000
#: Lengths of beginnings of longer words that count beside whole words, for inflected and compound forms.
BEGINNINGS = (4, 5, 6, 7)
#: Chunks of so many characters may be parts of a word that is set apart; those less likely than this are no usual words.
SHORT, USUAL = 3, math.log(2e-4)
#: Look-alikes of letters.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_SEPARATORS = frozenset(".-_~'’`,:;·*/\\")
_WILD = frozenset("*#")
_EDGE = ".,;:?\"'()[]{}«»„“”"
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_WILD_RUN = re.compile(r"[*#]{2,}")
#: White space other than single spaces, for Arrow's expressions.
_GAPS = r"[\t\n\f\r ]{2,}|[\t\n\f\r]"
_TWICE = re.compile(r"(.)\1+")
#: Combining marks, letter-like and enclosed signs, full-width and mathematical letters: what compatible forms replace.
_VARIANTS = r"[\x{300}-\x{36f}\x{2100}-\x{214f}\x{2460}-\x{24ff}\x{ff00}-\x{ffef}\x{1d400}-\x{1d7ff}]"
#: Symbols of the model: 0 before a word, 1 to 26 the letters, 27 behind a word.
SYMBOLS, BEHIND = 28, 27
_CONTEXTS = SYMBOLS**3
#: Kinds of chunks: letters of other scripts, no part of a stretch by itself, short, short and no usual word.
_APART, _OTHER, _JOINS, _SEED = -1, 0, 1, 2


def _folds() -> dict[int, str]:
    """Latin letters with marks to the letters below them; what has no such letter stays."""
    out = {}
    for code in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if "a" <= c <= "z")
        if plain:
            out[code] = plain
    return out | {0xDF: "ss", 0xE6: "ae", 0xF8: "o", 0x153: "oe", 0x131: "i", 0x142: "l"}


_FOLDS = _folds()


def fold(text: str) -> str:
    """A text in small letters without marks; full-width and other compatible forms become the plain ones."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower().translate(_FOLDS)


def _fold_words(words: list[str]) -> list[str]:
    """Small words of plain letters without marks, all at once."""
    joined = " ".join(words)
    for char in set(joined):
        plain = _FOLDS.get(ord(char))
        if plain is not None:
            joined = joined.replace(char, plain)
    return joined.split(" ") if words else []


def compatible(texts: pa.Array) -> pa.Array:
    """The texts, with the compatible forms of the characters of those that hold variants."""
    found = pc.match_substring_regex(texts, _VARIANTS)
    if not pc.any(found).as_py():
        return texts
    return pc.replace_with_mask(texts, found, pa.array([unicodedata.normalize("NFKC", t) for t in texts.filter(found).to_pylist()], texts.type))


def forms(word: str) -> list[str]:
    """A word and its beginnings, none of which is the whole word."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


# --- the character model --------------------------------------------------------------------------------------------


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words of a to z, three before and one behind each, and the four-gram that ends at each symbol from the fourth on."""
    text = np.frombuffer("".join(f"```{w}{{" for w in words).encode(), np.uint8).astype(np.int64) - 96
    return text, ((text[:-3] * SYMBOLS + text[1:-2]) * SYMBOLS + text[2:-1]) * SYMBOLS + text[3:]


def gram_counts(words: list[str], times: np.ndarray, into: np.ndarray) -> None:
    """Add the four-grams of words of a to z, each with three symbols before and one behind it."""
    if not words:
        return
    text, keys = _symbols(words)
    weight = np.repeat(times, [len(w) + 4 for w in words])[3:]
    inside = text[3:] > 0
    into += np.bincount(keys[inside], weight[inside], SYMBOLS**4)


def _latin_words(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The folded words of a to z of all texts with how often they stand there; a word may come several times."""
    # line ends part words like spaces
    chunks, codes, _ = chunk_table(pc.replace_substring(texts, "\n", " "))
    parts = part_table(chunks, lower=True)
    times = np.bincount(parts.first[codes], minlength=len(parts.letters) + len(parts.marks) + len(parts.others))
    # chunks of plain letters are words; all others are searched for them
    words = _fold_words(parts.letters)
    weights = times[: len(words)].tolist()
    for chunk, n in zip(parts.others, times[len(words) + len(parts.marks) :].tolist()):
        found = _LETTER_RUN.findall(fold(chunk))
        words += found
        weights += [n] * len(found)
    latin = list(map(str.isascii, words))
    return list(compress(words, latin)), np.array(list(compress(weights, latin)), float)


def count_grams(docs: DataFrame) -> np.ndarray:
    """Four-grams of all words of all documents; at most ``SYMBOLS`` ** 4 sums reach the driver."""
    schema = StructType([StructField("gram", IntegerType()), StructField("n", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        sums = np.zeros(SYMBOLS**4)
        for part in batch_slices(batches):
            words, weights = _latin_words(part["text"])
            gram_counts(words, weights, sums)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sums[found])], names=["gram", "n"])

    rows = map_arrow(docs.select("text"), run, schema).groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS**4)
    for r in rows.collect():
        out[r["gram"]] = r["n"]
    return out


def fit_characters(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of each symbol behind each three: four-grams, smoothed by the shorter ones with the weight of the number of symbols seen."""
    four = counts.reshape((SYMBOLS,) * 4)
    chance = np.full(SYMBOLS, 1.0 / (SYMBOLS - 1))
    chance[0] = 0.0
    for grams in (four.sum((0, 1, 2)), four.sum((0, 1)), four.sum(0), four):
        seen, total = np.maximum(1, (grams > 0).sum(-1, keepdims=True)), grams.sum(-1, keepdims=True)
        chance = (grams + seen * chance) / (total + seen)
    with np.errstate(divide="ignore"):
        return np.log(chance).astype(np.float32).ravel()


class Characters:
    """The model as a flat list: the entry of context * SYMBOLS + symbol."""

    def __init__(self, table: np.ndarray):
        self.array, self.table = table, table.tolist()

    def word(self, word: str) -> float:
        """The log probability of a word of a to z."""
        table, context, total = self.table, 0, 0.0
        for c in word:
            at = context * SYMBOLS + ord(c) - 96
            total += table[at]
            context = at % _CONTEXTS
        return total + table[context * SYMBOLS + BEHIND]

    def check(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of a to z: their log probabilities, and whether one letter less of a repeated one may be likelier."""
        if not words:
            return np.zeros(0), np.zeros(0, bool)
        text, keys = _symbols(words)
        size = np.array([len(w) + 4 for w in words])
        ends = np.cumsum(size)
        chance = np.concatenate([np.zeros(3), np.where(text[3:] > 0, self.array[keys], 0.0)])
        total = np.add.reduceat(chance, ends - size)
        at = np.flatnonzero((text[1:] == text[:-1]) & (text[1:] > 0) & (text[1:] < BEHIND)) + 1
        s = np.concatenate([text, np.zeros(4, np.int64)])
        chance = np.concatenate([chance, np.zeros(4)])
        gain, held = -chance[at], np.ones(len(at), bool)
        before = [s[at - 3], s[at - 2], s[at - 1]]
        for k in (1, 2, 3):
            symbol = s[at + k]
            held = held & (symbol > 0)
            gain += np.where(held, self.array[((before[0] * SYMBOLS + before[1]) * SYMBOLS + before[2]) * SYMBOLS + symbol] - chance[at + k], 0.0)
            before = [before[1], before[2], symbol]
        thrice = (at >= 2) & (s[at - 2] == s[at])
        doubtful = np.zeros(len(words), bool)
        doubtful[np.searchsorted(ends, at[(gain > _COLLAPSE) | thrice], side="right")] = True
        return total, doubtful


# --- the channel ----------------------------------------------------------------------------------------------------


def _logs(pairs: list[tuple[str, float]]) -> list[tuple[tuple[int, ...], float, str]]:
    return [(tuple(BEHIND if c == " " else ord(c) - 96 for c in out), math.log(p), out) for out, p in pairs]


def _outputs(char: str, times: int) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with its chance; a space ends a word."""
    letter = _FOLDS.get(ord(char), char)
    if letter.isascii() and letter.isalpha():
        return [(letter, 1.0)] if times == 1 else [(letter * 2, 0.93), (letter, 0.07)] if times == 2 else [(letter, 0.55), (letter * 2, 0.45)]
    if char == " ":
        return [(" ", 0.85), ("", 0.15)]
    likes = LOOKALIKES.get(char, "")
    out = [(" ", 0.55), ("", 0.35)] if char in _SEPARATORS else [(" ", 0.2), ("", 0.02)] if likes else [(" ", 0.9), ("", 0.1)]
    out += [(letter, 0.7 / len(likes)) for letter in likes]
    if times > 1:
        out += [(letter * 2, 0.2 / len(likes)) for letter in likes]
    if char in _WILD and times == 1:
        out += [(chr(c), 0.3 / 26) for c in range(97, 123)]
    return out


#: A letter less must make a word so much likelier before a repeated letter is taken for one.
_COLLAPSE = math.log(0.93 / 0.07)
_CHANNEL: dict[tuple[str, int], list] = {}
#: Symbols of single letters, which stand for themselves alone.
_PLAIN = {chr(c): c - 96 for c in range(97, 123)}


def _channel(char: str, times: int) -> list:
    key = (char, min(times, 3))
    found = _CHANNEL.get(key)
    if found is None:
        found = _logs(_outputs(*key))
        if ord(char) < 0x250:
            _CHANNEL[key] = found
    return found


def decode(written: str, characters: Characters) -> str:
    """The likeliest intended text, in a to z: Viterbi over the lattice of the text's runs, with the last three symbols as state; wild signs side by side are one run."""
    table, written = characters.table, written.lower()
    #: A context alone is kept apart from the others, as that is the usual case.
    context, score, path, best = 0, 0.0, None, None
    if "*#" in written or "#*" in written:
        written = _WILD_RUN.sub(lambda m: m[0][0] * len(m[0]), written)
    at_char, size = 0, len(written)
    while at_char < size:
        char, begin = written[at_char], at_char
        at_char += 1
        while at_char < size and written[at_char] == char:
            at_char += 1
        symbol = _PLAIN.get(char) if at_char == begin + 1 else None
        if symbol is not None and best is None:
            # a letter that stands for itself
            at = context * SYMBOLS + symbol
            context, score, path = at % _CONTEXTS, score + table[at], (path, char)
            continue
        if best is None:
            best = {context: (score, path)}
        reached: dict[int, tuple[float, tuple | None]] = {}
        if symbol is not None:
            for context, (score, path) in best.items():
                at = context * SYMBOLS + symbol
                total, now = score + table[at], at % _CONTEXTS
                old = reached.get(now)
                if old is None or total > old[0]:
                    reached[now] = (total, (path, char))
            best = reached
            if len(best) == 1:
                ((context, (score, path)),) = best.items()
                best = None
            continue
        choices = _channel(char, at_char - begin)
        if len(best) * len(choices) > BEAM:
            best = dict(heapq.nlargest(max(1, BEAM // len(choices)), best.items(), key=lambda x: x[1][0]))
        for context, (score, path) in best.items():
            for symbols, cost, text in choices:
                now, total = context, score + cost
                for s in symbols:
                    if s == BEHIND:
                        if now:
                            total += table[now * SYMBOLS + BEHIND]
                            now = 0
                    else:
                        at = now * SYMBOLS + s
                        total += table[at]
                        now = at % _CONTEXTS
                old = reached.get(now)
                if old is None or total > old[0]:
                    reached[now] = (total, (path, text) if text else path)
        best = reached
        if len(best) == 1:
            ((context, (score, path)),) = best.items()
            best = None
    best = {context: (score, path)} if best is None else best
    _, path = max(((score + (table[context * SYMBOLS + BEHIND] if context else 0.0), path) for context, (score, path) in best.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


# --- restoring texts ------------------------------------------------------------------------------------------------


@dataclass
class ToxicModel:
    lexicon: dict[str, float]  # word to weight
    characters: np.ndarray | None  # log probabilities
    weights: np.ndarray | None  # of the features of features()


class Read(NamedTuple):
    """A slice of texts as read: chunks of letters, restored words of the parts that are no such chunks or stand for other words, and the stretches."""

    letters: pa.Array
    restored: dict[int, tuple[str, ...]]
    size: int
    of_chunk: np.ndarray
    inside: np.ndarray
    offsets: np.ndarray
    stretches: list[tuple[int, tuple[str, ...], tuple[str, ...]]]  # text, words as written, restored words
    written: dict[str, str]  # folded words of stretches to words as written


class Restorer:
    """The restored words of texts; one instance lives in each Python worker."""

    def __init__(self, lexicon: dict[str, float], characters: np.ndarray, decoder=decode):
        names = sorted(lexicon)
        self.names = pa.array(names, pa.string())
        self.number = {fold(w): i for i, w in reversed(list(enumerate(names)))} | {w: i for i, w in enumerate(names)}
        #: Words by their letters without repetition, for restored ones that lost a letter of a pair.
        self.single = {_TWICE.sub(r"\1", w): i for w, i in reversed(self.number.items()) if not w.endswith("*")}
        self.weight = np.array([lexicon[w] for w in names])
        self.characters = Characters(characters)
        self.decoder = decoder
        self.restored = BoundedCache(lambda w: tuple(self.decoder(w, self.characters).split()), CACHED_STRETCHES, longest=256)
        self.other = BoundedCache(self._other, CACHED_CHUNKS)

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, dict[int, tuple[str, ...]]]:
        """The kinds of chunks of letters, and the restored words of those that stand for others."""
        folded = words.to_numpy(zero_copy_only=False).tolist()
        marked = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)).tolist()
        lowered = {i: folded[i] for i in marked}
        latin, length = np.ones(len(folded), bool), pc.utf8_length(words).to_numpy(zero_copy_only=False).copy()
        for i, own in zip(marked, _fold_words([folded[i] for i in marked])):
            folded[i] = own
            latin[i], length[i] = own.isascii(), len(own)
        chance, doubtful = np.zeros(len(folded)), np.zeros(len(folded), bool)
        chance[latin], doubtful[latin] = self.characters.check(folded if latin.all() else [w for w, own in zip(folded, latin.tolist()) if own])
        kind = np.where(~latin, _APART, np.where(length > SHORT, _OTHER, np.where(chance >= USUAL, _JOINS, _SEED))).astype(np.int8)
        # marks may be a disguise: a word that is toxic without them
        restored = {i: (folded[i],) for i in marked if folded[i] in self.number and lowered[i] not in self.number}
        for i in np.flatnonzero(doubtful).tolist():
            own = self.restored[lowered.get(i, folded[i])]
            if own != (folded[i],):
                restored[i] = own
        return kind, restored

    def _other(self, chunk: str) -> tuple[int, tuple[str, ...]]:
        """Kind and restored words of any other chunk."""
        core = chunk.lower().strip(_EDGE)
        letters = [c for c in core if c.isalpha()]
        if not fold("".join(letters)).isascii():
            return _APART, tuple(_LETTER_RUN.findall(core))
        likes = sum(c in LOOKALIKES for c in core)
        if len(core) <= SHORT:
            kind = _OTHER if not letters and not likes else _SEED if letters and likes else _JOINS
        else:
            kind = _OTHER
        if letters or likes == len(core) >= SHORT:
            return kind, tuple(self.decoder(core, self.characters).split())
        return kind, ()

    def _read(self, texts: pa.Array) -> Read:
        chunks, codes, offsets = chunk_table(pc.replace_substring_regex(compatible(pc.fill_null(texts, "").cast(pa.large_string())), _GAPS, " "))
        parts = part_table(chunks, lower=True)
        letters = pa.array(parts.letters, pa.string())
        kinds, restored = self._letters(letters)
        base = len(parts.letters) + len(parts.marks)
        others = [self.other[c] for c in parts.others]
        restored |= {base + i: words for i, (_, words) in enumerate(others)}
        of_chunk = parts.first[codes]
        kind = np.concatenate([kinds, np.full(len(parts.marks), _OTHER, np.int8), np.array([k for k, _ in others], np.int8)])[of_chunk] if len(codes) else np.zeros(0, np.int8)
        single = np.concatenate([pc.utf8_length(letters).to_numpy() == 1, np.zeros(len(parts.marks), bool), np.array([k > _OTHER and len(c.strip(_EDGE)) == 1 for c, (k, _) in zip(parts.others, others)], bool)])[of_chunk] if len(codes) else np.zeros(0, bool)
        inside = self._stretches(kind, single, offsets)
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        edge[offsets[:-1][offsets[:-1] < len(codes)]] |= inside[offsets[:-1][offsets[:-1] < len(codes)]]
        begins = np.flatnonzero(edge[:-1] > 0 if len(codes) else edge)
        names, stretches = pc.utf8_lower(chunks).to_numpy(zero_copy_only=False).tolist() if len(begins) else [], []
        owners = (np.searchsorted(offsets, begins, side="right") - 1).tolist()
        stops = np.append(~inside, True)
        stops[offsets] = True
        stops = np.flatnonzero(stops)
        ends = stops[np.searchsorted(stops, begins, side="right")].tolist()
        known: dict[str, str] = {}
        for a, b, doc in zip(begins.tolist(), ends, owners):
            written = [names[c] for c in codes[a:b].tolist()]
            cores = tuple(core for w in written if (core := w.strip(_EDGE)))
            known |= {fold(core): core for core in cores}
            stretches.append((doc, cores, self.restored[" ".join(written)]))
        return Read(letters, restored, base + len(others), of_chunk, inside, offsets, stretches, known)

    def texts(self, texts: pa.Array, as_written: bool = False) -> list[list[str]]:
        """The restored words of every text, those of stretches behind the others; words of letters may be left as they are written."""
        read = self._read(texts)
        if as_written:
            restored = {i: words for i, words in read.restored.items() if i >= len(read.letters)}
            read = read._replace(restored=restored)
        out, letters = [], read.letters.to_pylist()
        for a, b in zip(read.offsets[:-1].tolist(), read.offsets[1:].tolist()):
            own = read.of_chunk[a:b][~read.inside[a:b]]
            out.append([w for c in own.tolist() for w in read.restored.get(c) or (letters[c : c + 1] if c not in read.restored else ())])
        for doc, _, words in read.stretches:
            out[doc] += [read.written.get(w, w) for w in words]
        return out

    def hits(self, texts: pa.Array) -> list[list[int]]:
        """The numbers of the toxic words of every restored text, each word's that of its form with the largest weight."""
        read = self._read(texts)
        own: dict[int, tuple[int, ...]] = {}
        words = read.letters
        for form in (words, *(pc.if_else(pc.greater(pc.utf8_length(words), n), pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), "*", ""), None) for n in BEGINNINGS)):
            number = pc.index_in(form, self.names)
            for i in np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False)).tolist():
                found = number[i].as_py()
                if i not in own or self.weight[found] > self.weight[own[i][0]]:
                    own[i] = (found,)
        # a word that is toxic as written needs no other reading
        own |= {i: tuple(n) for i, w in read.restored.items() if i not in own and (n := self.numbers(w))}
        marked = np.zeros(read.size, bool)
        marked[list(own)] = True
        out: list[list[int]] = [[] for _ in range(len(texts))]
        at = np.flatnonzero(marked[read.of_chunk] & ~read.inside)
        for doc, code in zip((np.searchsorted(read.offsets, at, side="right") - 1).tolist(), read.of_chunk[at].tolist()):
            out[doc].extend(own[code])
        for doc, cores, words in read.stretches:
            out[doc] += [*self.numbers(cores), *self._joined({fold(core) for core in cores}, words)]
        return out

    def _joined(self, known: set[str], words: tuple[str, ...]) -> list[int]:
        """The numbers of words put together in a stretch, and of such joined to their neighbours; they count as whole words only, as their beginnings may be words of their own."""
        get, out, at = self.number.get, [], 0
        while at < len(words):
            for end in range(min(len(words), at + MOST_JOINED), at, -1):
                number = get("".join(words[at:end]))
                if number is not None and any(w not in known for w in words[at:end]):
                    out.append(number)
                    break
            else:
                end = at + 1
            at = end
        return out

    def numbers(self, words: tuple[str, ...]) -> list[int]:
        """The numbers of restored words, which have no marks on their letters."""
        out = []
        for word in words:
            own = [self.number[form] for form in forms(word) if form in self.number]
            out += [max(own, key=self.weight.__getitem__)] if own else self._single(word)
        return out

    def _single(self, word: str) -> list[int]:
        number = self.single.get(_TWICE.sub(r"\1", word))
        return [] if number is None else [number]

    @staticmethod
    def _stretches(kind: np.ndarray, single: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which chunks lie in a run of short ones with a seed (one that is no usual word, or three single characters in a row), or beside one in the same text."""
        inside = np.zeros(len(kind), bool)
        seeds = kind == _SEED
        seeds[2:] |= single[2:] & single[1:-1] & single[:-2]
        if not seeds.any():
            return inside
        short = kind > _OTHER
        first = short.copy()
        first[1:] &= ~short[:-1]
        text_start = offsets[:-1][offsets[:-1] < len(kind)]
        first[text_start] |= short[text_start]
        number = np.cumsum(first) - 1
        held = np.zeros(int(first.sum()), bool)
        held[number[seeds]] = True
        inside[short] = held[number[short]]
        begins, ends = np.zeros(len(kind), bool), np.zeros(len(kind), bool)
        begins[text_start] = True
        ends[:-1] = begins[1:]
        wide = inside.copy()
        wide[1:] |= inside[:-1] & ~begins[1:]
        wide[:-1] |= inside[1:] & ~ends[:-1]
        return wide & (kind != _APART)


# --- learning and scoring -------------------------------------------------------------------------------------------


def features(hits: list[int], weight: np.ndarray) -> list[float]:
    own = sorted((float(weight[h]) for h in set(hits)), reverse=True)
    return [1.0, float(bool(hits)), math.log1p(len(hits)), own[0] if own else 0.0, min(sum(own), 40.0) / 10.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _smallest(words: set[str], seed: int) -> tuple[int, int]:
    """The two min-hashes of a word set under a seed; sets that share most words share both most of the time."""
    hashes = [xxhash.xxh128_intdigest(w, seed) for w in words]
    return min((h >> 65 for h in hashes), default=0), min((h & ((1 << 63) - 1) for h in hashes), default=0)


def _sample_words(sample: DataFrame, characters: np.ndarray) -> DataFrame:
    """toxic, min-hashes (h0 to h5) and the distinct restored words with their beginnings of every sampled document."""
    schema = StructType([StructField("toxic", IntegerType()), *(StructField(f"h{i}", LongType()) for i in range(6)), StructField("words", ArrayType(StringType()))])
    sent = sample.sparkSession.sparkContext.broadcast(characters)
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        restorer = held(("characters", number), lambda: Restorer({}, sent.value))
        for part in batch_slices(batches):
            words = [set(own) for own in restorer.texts(part["text"], as_written=True)]
            least = [[h for seed in range(3) for h in _smallest(w, seed)] for w in words]
            yield pa.RecordBatch.from_arrays([part["toxic"].cast(pa.int32()), *(pa.array([row[i] for row in least], pa.int64()) for i in range(6)), pa.array([sorted({f for word in w for f in forms(word)}) for w in words], arrow.field(7).type)], schema=arrow)

    return map_arrow(sample.select("toxic", "text"), run, schema)


def _hits(docs: DataFrame, model: ToxicModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the features of every text."""
    schema = StructType([*(docs.schema[k] for k in keep), StructField("features", ArrayType(DoubleType(), False))])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        restorer = held(("toxicity", number), lambda: Restorer(sent.value.lexicon, sent.value.characters))
        for part in batch_slices(batches):
            rows = [features(h, restorer.weight) for h in restorer.hits(part["text"])]
            yield pa.RecordBatch.from_arrays([*(part[k].cast(arrow.field(i).type) for i, k in enumerate(keep)), pa.array(rows, arrow.field(len(keep)).type)], schema=arrow)

    return map_arrow(docs.select(*keep, "text"), run, schema)


def choose_words(counts: dict[str, tuple[int, int]], toxic: int, clean: int, least: int = LEAST_DOCS) -> dict[str, float]:
    """Words and beginnings whose share among toxic documents is surely larger: to the least likely log ratio of shares."""
    out = {}
    for word, (a, b) in counts.items():
        if a < max(least, 0.004 * toxic):
            continue
        ratio = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        spread = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        sure = ratio - 2.5 * spread
        if sure > 0.7:
            out[word] = sure
    return out


def _sample(docs: DataFrame, known: DataFrame, per_class: int) -> DataFrame:
    """toxic and text of at most ``per_class`` labelled documents of each class, those with the smallest hashes of their ids."""
    spark = docs.sparkSession
    order = [F.xxhash64("doc_id", F.lit(5)), "doc_id"]
    ids = [(r["doc_id"], r["toxic"]) for k in (0, 1) for r in known.where(F.col("toxic") == k).orderBy(*order).limit(per_class).collect()]
    chosen = spark.createDataFrame(ids, StructType([known.schema["doc_id"], StructField("toxic", IntegerType())]))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = SAMPLE_PER_CLASS) -> ToxicModel:
    """Learn the character model from all documents, and toxic words and the score from labels (doc_id, toxic) where ``train`` holds."""
    known = labels.where(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return ToxicModel({}, None, None)
    characters = fit_characters(count_grams(docs))
    sample = materialize(_sample(docs, known, per_class), "toxic-sample")
    own = _sample_words(sample, characters)
    for i in (0, 2, 4):
        own = own.groupBy("toxic", f"h{i}", f"h{i + 1}").agg(F.min(F.struct(*[f"h{k}" for k in range(6) if k not in (i, i + 1)], "words")).alias("row")).select("toxic", f"h{i}", f"h{i + 1}", "row.*")
    own = materialize(own.select("toxic", "words", "h0", "h2", "h4"), "toxic-words")
    totals = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = F.col("toxic") == 1
    words = own.select("toxic", "h0", "h2", "h4", F.explode("words").alias("word")).groupBy("word")
    words = words.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"), F.greatest(*(F.size(F.collect_set(F.when(toxic, F.col(h)))) for h in ("h0", "h2", "h4"))).alias("groups"))
    words = words.where((F.col("a") >= LEAST_DOCS) & (F.col("groups") >= LEAST_GROUPS))
    counts = {r["word"]: (r["a"], r["b"]) for r in words.collect()}
    model = ToxicModel(choose_words(counts, totals.get(1, 0), totals.get(0, 0)), characters, None)
    rows = sorted((r["toxic"], r["features"]) for r in _hits(sample, model, ["toxic"]).collect())
    if rows:
        y = np.array([toxic for toxic, _ in rows], float)
        natural = {k: sizes[k] / max(1, int((y == k).sum())) for k in (0, 1)}
        weight = np.where(y == 1, natural[1], natural[0])
        model.weights = fit_logistic(np.array([own for _, own in rows]), y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and score of every document."""
    if model.weights is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    found = _hits(docs, model, ["doc_id"])
    sums = sum((F.lit(float(w)) * F.col("features")[i] for i, w in enumerate(model.weights)), F.lit(0.0))
    return found.select("doc_id", (1 / (1 + F.exp(-sums))).alias("score"))
