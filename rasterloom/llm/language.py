"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, found
by a forward algorithm; a text's is the product over its words.  Pieces never
reach over a word's ends, so the sum over all segmentations of a text is the
product of its words' sums, and each distinct word is scored once and kept in a
bounded cache.  The probabilities are fitted by expectation maximisation on the
words of all labelled documents: their counts are one table, each round goes over
its distinct words in parallel, and one sum per language and piece reaches the driver.

A word is a run of letters in lower case; characters without a piece fall back
to the vocabulary's byte pieces.

Defined cases: a text that is null or has no letters is ``und`` with score 0; of
equal scores the smaller language name wins; without labelled documents all
texts are ``und``; filters keep all columns, whatever their names.

A share of the probability is high for gibberish and unlearned languages too, so
the filter also asks how likely the text is in its language: its log probability
for each character may not lie far below what all training documents have.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from rasterloom.llm.chunks import IntTable, chunk_table, part_table
from rasterloom.llm.common import BoundedCache, batch_slices, held, map_arrow, release_held
from rasterloom.session import materialize

UNKNOWN = "und"
ROUNDS = 3
SMOOTHING = 0.05
#: Expected counts are summed as whole numbers of this part of one, so that no sum depends on its order.
COUNT_UNIT = 1 << 20
CACHED_WORDS = 200_000
#: A text's log probability for each character may lie so many spreads (one counts as so much at least) below its language's mean.
SPREADS, LEAST_SPREAD = 10.0, 0.15
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; number signs that count as word characters are no letters."""
    words = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [own for w in words if (own := "".join(filter(str.isalpha, w)))]


def read_pieces(path: str) -> tuple[dict[str, int], list[int]]:
    """Piece to id, and the ids of the 256 byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, byte_ids = {}, [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces[piece] = i
    return pieces, byte_ids


class Lattice:
    """All segmentations of a word: edges (from, to, piece ids) in order of their start."""

    def __init__(self, path: str):
        self.pieces, self.byte_ids = read_pieces(path)
        self.size = 1 + max(max(self.pieces.values()), max(self.byte_ids))
        #: Characters of the longest piece: sums reach no farther ahead than that.
        self.longest = max(map(len, self.pieces))
        trie: dict = {}
        for piece, i in self.pieces.items():
            node = trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = i
        self.trie = trie

    def edges(self, word: str) -> list[tuple[int, int, tuple[int, ...]]]:
        chars, out = _START + word, []
        for start in range(len(chars)):
            node, end, single = self.trie, start, False
            for char in chars[start : start + self.longest]:
                node = node.get(char)
                if node is None:
                    break
                end += 1
                if "" in node:
                    out.append((start, end, (node[""],)))
                    single |= end == start + 1
            if not single:
                out.append((start, start + 1, tuple(self.byte_ids[b] for b in chars[start].encode("utf-8", "surrogatepass"))))
        return out


@dataclass
class LanguageModel:
    path: str
    languages: list[str]
    piece_ids: np.ndarray  # ids of the pieces with own probabilities, ascending
    probabilities: np.ndarray  # one row per such piece, one column per language
    rest: np.ndarray  # probability of any other piece, per language


_TINY, _LIFT = 1e-150, 1e150
#: Words of up to so many characters are scored many at once, ``TOGETHER`` at a time; sums below ``_LEAST`` are taken again one by one.
LOCKSTEP_CHARS, TOGETHER, _LEAST = 40, 4000, 1e-280


class Automaton:
    """The pieces' trie in arrays: a step from many nodes at once."""

    def __init__(self, pieces: dict[str, int]):
        steps: dict[int, int] = {}
        ends = {}
        for piece, i in pieces.items():
            node = 0
            for char in piece:
                node = steps.setdefault(node << 21 | ord(char), len(steps) + 1)
            ends[node] = i
        self.table = IntTable(max(4, (2 * len(steps) + 2).bit_length()))
        self.table.put(np.fromiter(steps.keys(), np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps)))
        self.piece = np.full(len(steps) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def edges(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all pieces in the characters that end by each place's word's end, and -1 as piece of single characters that are none."""
        place, node, length = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        found = []
        while len(place):
            node = self.table.get(node << 21 | chars[place + length]).astype(np.int64)
            length += 1
            piece = np.where(node >= 0, self.piece[node], -1)
            whole = piece >= 0 if length > 1 else np.ones(len(place), bool)
            found.append((place[whole], np.full(int(whole.sum()), length), piece[whole]))
            onward = (node >= 0) & (place + length < ends[place])
            place, node = place[onward], node[onward]
        return tuple(np.concatenate(column) for column in zip(*found))


class Edges(NamedTuple):
    """All edges of many words, in order of start and length; a word has one at most of each start and length."""

    size: np.ndarray  # of each word, with its start
    word: np.ndarray
    start: np.ndarray
    length: np.ndarray
    piece: np.ndarray  # -1 for a character that is none
    char: np.ndarray  # at the start
    steps: list[tuple[int, int, int, int]]  # first and last edge, start and end of those that are followed together


def edges_together(automaton: Automaton, words: list[str]) -> Edges:
    chars = np.frombuffer("".join(_START + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = np.array([len(w) + 1 for w in words])
    last = np.cumsum(size)
    ends, owner = np.repeat(last, size), np.repeat(np.arange(len(words)), size)
    place, length, piece = automaton.edges(chars, ends)
    word = owner[place]
    start = place - (last - size)[word]
    step = start * (int(length.max()) + 1) + length
    order = np.argsort(step, kind="stable")
    step, start, length = step[order], start[order], length[order]
    cuts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]]))
    begins = cuts[:-1]
    steps = list(zip(begins.tolist(), cuts[1:].tolist(), start[begins].tolist(), (start + length)[begins].tolist()))
    return Edges(size, word[order], start, length, piece[order], chars[place][order], steps)


class Scorer:
    """Log probabilities of words in every language; one instance lives in each Python worker."""

    def __init__(self, model: LanguageModel):
        self.lattice, self.n = Lattice(model.path), len(model.languages)
        self.rows = {int(i): tuple(row) for i, row in zip(model.piece_ids, model.probabilities.tolist(), strict=True)}
        self.rest = tuple(model.rest.tolist())
        self.automaton = Automaton(self.lattice.pieces)
        #: Rows of all probabilities, the last that of any other piece, and each piece's row.
        self.table = np.vstack([model.probabilities, model.rest[None]])
        self.row = np.full(self.lattice.size, len(self.table) - 1)
        self.row[model.piece_ids] = np.arange(len(model.piece_ids))
        self.words = BoundedCache(self._word, CACHED_WORDS)

    def _piece(self, ids: tuple[int, ...]) -> tuple[float, ...]:
        row = self.rows.get(ids[0], self.rest)
        for i in ids[1:]:
            row = tuple(a * b for a, b in zip(row, self.rows.get(i, self.rest)))
        return row

    def _word(self, word: str) -> tuple[float, ...]:
        """The forward algorithm; sums that get very small are lifted together and the lift is taken off the logarithm."""
        n, size = self.n, len(word) + 1
        forward: list[list[float] | None] = [None] * (size + 1)
        forward[0] = [1.0] * n
        lifts = [0] * n
        at = 0
        rows, rest, longest = self.rows, self.rest, self.lattice.longest
        for start, end, ids in self.lattice.edges(word):
            if start != at:
                at = start
                for k in range(n):
                    if 0 < forward[at][k] < _TINY:
                        lifts[k] += 1
                        for sums in forward[at : at + longest]:
                            if sums is not None:
                                sums[k] *= _LIFT
            here, row = forward[start], rows.get(ids[0], rest) if len(ids) == 1 else self._piece(ids)
            sums = forward[end]
            if sums is None:
                forward[end] = [a * b for a, b in zip(here, row)]
            else:
                for k in range(n):
                    sums[k] += here[k] * row[k]
        return tuple(math.log(max(p, 1e-300)) - lift * math.log(_LIFT) for p, lift in zip(forward[size], lifts))

    def _lockstep(self, words: list[str]) -> np.ndarray:
        """The forward algorithm for many words at once: all their edges of equal start and length are followed together."""
        edges = edges_together(self.automaton, words)
        row, table = self.row[edges.piece], self.table
        single = np.flatnonzero(edges.piece < 0)
        if len(single):
            unknown, which = np.unique(edges.char[single], return_inverse=True)
            table = np.vstack([table, np.array([self._piece(tuple(self.lattice.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass"))) for c in unknown.tolist()])])
            row[single] = len(self.table) + which
        forward = np.zeros((int(edges.size.max()) + 1, len(words), self.n))
        forward[0] = 1.0
        for a, b, s, e in edges.steps:
            own = edges.word[a:b]
            forward[e, own] += forward[s, own] * table[row[a:b]]
        whole = forward[edges.size, np.arange(len(words))]
        with np.errstate(divide="ignore"):
            out = np.log(whole)
        for i in np.flatnonzero((whole < _LEAST).any(axis=1)).tolist():
            out[i] = self._word(words[i])
        return out

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words in every language; what was scored before comes from the cache."""
        known = self.words
        out = list(map(known.get, words))
        new = sorted((w for w, row in zip(words, out) if row is None and 0 < len(w) <= LOCKSTEP_CHARS), key=len)
        fresh = {}
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            fresh.update(zip(part, map(tuple, self._lockstep(part).tolist())))
        if len(known) + len(fresh) > CACHED_WORDS:
            known.clear()
        known.update(fresh)
        return np.array([row if row is not None else fresh[w] if w in fresh else known[w] for w, row in zip(words, out)]).reshape(len(words), self.n)

    def score_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of every text, and each text's number of words."""
        scores, words, _ = self.measure_texts(texts)
        return scores, words

    def measure_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities of every text, its number of words, and its number of characters in words, with one for each word's start."""
        chunks, codes, offsets = chunk_table(texts)
        parts = part_table(chunks, lower=True)
        own = np.zeros((len(parts.letters) + len(parts.marks) + len(parts.others), self.n + 2))
        if self.n and parts.letters:
            rows = self.score_words(parts.letters)
            own[: len(rows), :-2], own[: len(rows), -2], own[: len(rows), -1] = rows, 1, [len(w) + 1 for w in parts.letters]
        elif parts.letters:
            own[: len(parts.letters), -2], own[: len(parts.letters), -1] = 1, [len(w) + 1 for w in parts.letters]
        for i, chunk in enumerate(parts.others, len(parts.letters) + len(parts.marks)):
            words = words_of(chunk)
            if words:
                own[i, :-2], own[i, -2:] = np.array(list(map(self.words.__getitem__, words))).reshape(len(words), self.n).sum(axis=0), (len(words), sum(map(len, words)) + len(words))
        of_chunk = own[parts.first]
        sums = [np.add.reduceat(column[codes], offsets[:-1]) for column in of_chunk.T] if len(texts) else [np.zeros(0)] * (self.n + 2)
        return np.array(sums[:-2]).reshape(self.n, len(texts)).T, sums[-2], sums[-1]


def _shares_of_long(edges: list[tuple[int, int, tuple[int, ...]]], size: int, chance: list[float]) -> list[float]:
    """The chance of each edge of a word too long for plain products, by sums of logarithms."""

    def add(x: float, y: float) -> float:
        low, high = min(x, y), max(x, y)
        return high if low == -math.inf else high + math.log1p(math.exp(low - high))

    weights = [sum(math.log(chance[i]) for i in ids) for _, _, ids in edges]
    forward, backward = [0.0, *[-math.inf] * size], [*[-math.inf] * size, 0.0]
    for (a, b, _), w in zip(edges, weights):
        forward[b] = add(forward[b], forward[a] + w)
    for (a, b, _), w in zip(reversed(edges), reversed(weights)):
        backward[a] = add(backward[a], backward[b] + w)
    return [math.exp(forward[a] + w + backward[b] - forward[size]) for (a, b, _), w in zip(edges, weights)]


class Expectation:
    """Expected counts of pieces in words; one instance lives in each Python worker."""

    def __init__(self, path: str):
        self.lattice = Lattice(path)
        self.automaton = Automaton(self.lattice.pieces)

    def _bytes(self, char: str) -> list[int]:
        return [self.lattice.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def counts(self, chance: np.ndarray, words: list[str], owner: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected counts in ``COUNT_UNIT`` by language and piece; ``chance``: one row per language, ``owner``: each word's language."""
        out = np.zeros(chance.shape, np.int64)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = [i for i in order if len(words[i]) <= LOCKSTEP_CHARS]
        alone = order[len(short) :]
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            alone += [part[i] for i in self._together(chance, [words[i] for i in part], owner[part], times[part], out)]
        lists: dict[int, list[float]] = {}
        for i in alone:
            k, word = int(owner[i]), words[i]
            if k not in lists:
                lists[k] = chance[k].tolist()
            edges = self.lattice.edges(word)
            for (_, _, ids), share in zip(edges, _shares_of_long(edges, len(word) + 1, lists[k])):
                for piece in ids:
                    out[k, piece] += round(share * int(times[i]) * COUNT_UNIT)
        return out

    def _together(self, chance: np.ndarray, words: list[str], owner: np.ndarray, times: np.ndarray, out: np.ndarray) -> list[int]:
        """Add the counts of many words to ``out`` by forward and backward sums; gives back those whose sums are too small for that."""
        edges, everyone = edges_together(self.automaton, words), np.arange(len(words))
        of = owner[edges.word]
        weight = chance[of, edges.piece]
        single = np.flatnonzero(edges.piece < 0)
        unknown, which = np.unique(edges.char[single], return_inverse=True)
        as_bytes = [self._bytes(chr(c)) for c in unknown.tolist()]
        if len(single):
            weight[single] = np.array([chance[:, ids].prod(axis=1) for ids in as_bytes])[which, of[single]]
        forward = np.zeros((int(edges.size.max()) + 1, len(words)))
        backward = np.zeros_like(forward)
        forward[0], backward[edges.size, everyone] = 1.0, 1.0
        for a, b, s, e in edges.steps:
            own = edges.word[a:b]
            forward[e, own] += forward[s, own] * weight[a:b]
        for a, b, s, e in reversed(edges.steps):
            own = edges.word[a:b]
            backward[s, own] += backward[e, own] * weight[a:b]
        whole = forward[edges.size, everyone]
        small = whole < _LEAST
        share = forward[edges.start, edges.word] * weight * backward[edges.start + edges.length, edges.word] / np.where(small, 1.0, whole)[edges.word]
        amount = np.where(small[edges.word], 0.0, np.rint(share * times[edges.word] * COUNT_UNIT))
        known = edges.piece >= 0
        out += np.bincount((of * out.shape[1] + edges.piece)[known], amount[known], out.size).astype(np.int64).reshape(out.shape)
        for ids, own in zip(as_bytes, np.bincount(which * len(out) + of[single], amount[single], len(unknown) * len(out)).astype(np.int64).reshape(-1, len(out))):
            for i in ids:
                out[:, i] += own
        return np.flatnonzero(small).tolist()


def _maximise(path: str, languages: list[str], size: int, expect: Callable[[np.ndarray], np.ndarray], rounds: int = ROUNDS) -> LanguageModel:
    """Rounds from equal piece probabilities; ``expect(chance)`` gives the expected counts of all words in ``COUNT_UNIT``."""
    chance, counts, total = np.full((len(languages), size), 1.0 / size), np.zeros((len(languages), size)), np.full(len(languages), SMOOTHING * size)
    for _ in range(rounds if languages else 0):
        counts = expect(chance) / COUNT_UNIT
        total = counts.sum(axis=1) + SMOOTHING * size
        chance = (counts + SMOOTHING) / total[:, None]
    ids = np.flatnonzero((counts > 0).any(axis=0))
    return LanguageModel(path, languages, ids.astype(np.int64), chance[:, ids].T.copy(), SMOOTHING / total)


def fit_words(path: str, counts: dict[str, dict[str, int]], rounds: int = ROUNDS) -> LanguageModel:
    """Expectation maximisation on counted words in one process; ``counts``: language to word to count."""
    own, languages = Expectation(path), sorted(counts)
    rows = [(k, word, n) for k, lang in enumerate(languages) for word, n in counts[lang].items()]
    owner, times = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    return _maximise(path, languages, own.lattice.size, lambda chance: own.counts(chance, [r[1] for r in rows], owner, times), rounds)


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n of all words of all documents."""
    schema = StructType([StructField("lang", StringType()), StructField("word", StringType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        release_held()
        arrow = to_arrow_schema(schema)
        for part in batch_slices(batches):
            chunks, codes, offsets = chunk_table(part["text"])
            parts = part_table(chunks, lower=True)
            langs = part["lang"].dictionary_encode()
            base, size = len(parts.letters) + len(parts.marks), len(parts.letters) + len(parts.marks) + len(parts.others)
            keys, times = np.unique(np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(offsets)) * size + parts.first[codes], return_counts=True)
            lang, own = keys // size, keys % size
            plain = own < len(parts.letters)
            words, owners, n = [parts.letters[i] for i in own[plain].tolist()], lang[plain].tolist(), times[plain].tolist()
            for k, i, count in zip(lang[~plain].tolist(), own[~plain].tolist(), times[~plain].tolist()):
                found = words_of(parts.others[i - base])
                words += found
                owners += [k] * len(found)
                n += [count] * len(found)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(owners, pa.int64())).cast(pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], schema=arrow)

    return map_arrow(docs.select("lang", "text"), run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(words: DataFrame, path: str, languages: list[str], chance: np.ndarray) -> np.ndarray:
    """One round over all counted words; at most one sum per language and piece reaches the driver."""
    schema = StructType([StructField("owner", IntegerType()), StructField("piece", IntegerType()), StructField("n", LongType())])
    sent = words.sparkSession.sparkContext.broadcast((languages, chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(("expectation", path), lambda: Expectation(path))
        names, table = sent.value
        sums, names = np.zeros(table.shape, np.int64), pa.array(names, pa.string())
        for batch in batches:
            owner = pc.index_in(batch["lang"].cast(pa.string()), names).to_numpy(zero_copy_only=False).astype(np.int64)
            sums += own.counts(table, batch["word"].to_pylist(), owner, batch["n"].to_numpy())
        owner, piece = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[owner, piece])], names=["owner", "piece", "n"])

    found = map_arrow(words, run, schema).groupBy("owner", "piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(chance.shape)
    out[found["owner"].to_numpy(), found["piece"].to_numpy()] = found["n"].to_numpy()
    sent.unpersist()
    return out


def _training(docs: DataFrame, train: Column) -> DataFrame:
    return docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def fit(docs: DataFrame, train: Column, path: str) -> LanguageModel:
    """Fit on the words of all labelled documents in ``train``."""
    words = materialize(_word_counts(_training(docs, train)), "language-words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    return _maximise(path, languages, Lattice(path).size, lambda chance: _expected(words, path, languages, chance))


def fit_with_floors(docs: DataFrame, train: Column, path: str) -> tuple[LanguageModel, np.ndarray]:
    """The model, and the least log probability for each character that a text of each language has, by all labelled documents in ``train``."""
    model = fit(docs, train, path)
    if not model.languages:
        return model, np.zeros(0)
    rates = _rates(_training(docs, train), model).groupBy("lang").agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("spread"))
    found = {r["lang"]: (r["mean"], r["spread"]) for r in rates.collect()}
    return model, np.array([mean - SPREADS * max(spread, LEAST_SPREAD) for mean, spread in (found[lang] for lang in model.languages)])


def _rates(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """lang and rate (log probability for each character in that language) of every text with words."""
    sent = send(docs, model)
    schema = StructType([StructField("lang", StringType()), StructField("rate", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scorer = _worker_scorer(sent)
        at = {lang: i for i, lang in enumerate(own.languages)}
        for part in batch_slices(batches):
            scores, _, chars = scorer.measure_texts(part["text"])
            rates = [(lang, row[at[lang]] / n) for lang, row, n in zip(part["lang"].to_pylist(), scores, chars.tolist(), strict=True) if n and lang in at]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rates], pa.string()), pa.array([r[1] for r in rates], pa.float64())], names=["lang", "rate"])

    return map_arrow(docs.select("lang", "text"), run, schema)


def verdicts(model: LanguageModel, scores: np.ndarray, words: np.ndarray) -> list[tuple[str, float]]:
    """The likeliest language of every text and its share of the text's probability."""
    if not model.languages:
        return [(UNKNOWN, 0.0)] * len(words)
    best = scores.argmax(axis=1)
    share = 1.0 / np.exp(scores - scores[np.arange(len(best)), best][:, None]).sum(axis=1)
    return [(model.languages[b], p) if n else (UNKNOWN, 0.0) for b, p, n in zip(best.tolist(), share.tolist(), words.tolist())]


def _worker_scorer(sent: _Sent) -> tuple[LanguageModel, Scorer]:
    """The worker's scorer for a broadcast model; kept over tasks."""
    return held(("language", sent.id), lambda: (sent.value, Scorer(sent.value)))


class _Sent:
    """A broadcast model with an id that stays equal in all workers."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self) -> LanguageModel:
        return self.broadcast.value


def send(docs: DataFrame, model: LanguageModel) -> _Sent:
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return _Sent(broadcast, broadcast._jbroadcast.id())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    sent = send(docs, model)
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        own, scorer = _worker_scorer(sent)
        for part in batch_slices(batches):
            found = verdicts(own, *scorer.score_texts(part["text"]))
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(arrow.field(0).type), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=arrow)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def filter_documents(docs: DataFrame, model: LanguageModel, least: float = 0.5, floors: np.ndarray | None = None) -> DataFrame:
    """The rows whose language is known with at least ``least``, and whose log probability for each character reaches that language's floor, with all their columns."""
    sent = send(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scorer = _worker_scorer(sent)
        for part in batch_slices(batches):
            scores, words, chars = scorer.measure_texts(part["text"])
            kept = np.array([lang != UNKNOWN and score >= least for lang, score in verdicts(own, scores, words)], bool)
            if floors is not None and len(floors):
                best = scores.argmax(axis=1)
                kept &= scores[np.arange(len(best)), best] >= floors[best] * chars
            yield part.filter(pa.array(kept, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
