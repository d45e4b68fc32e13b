"""The forward algorithm on words without a blank, in time that grows with their length."""

import math
import time

import numpy as np
import pytest

from rasterloom.llm import language, queries
from rasterloom.llm.queries import public_tokenizers

LETTERS = "theresandingerqueñodéüß漢"


@pytest.fixture(scope="module")
def scorer():
    rng = np.random.default_rng(3)
    path = public_tokenizers.path(queries.PIECES)
    pieces = list(language.read_pieces(path)[0].values())[:8000]
    shares = rng.random((len(pieces), 3)) ** 4 + 1e-9
    return language.Scorer(language.LanguageModel(path, ["a", "b", "c"], np.array(sorted(pieces)), 0.9 * shares / shares.sum(axis=0), np.full(3, 1e-6)))


def by_logarithms(scorer, word):
    """Every segmentation's sum with logarithms throughout."""
    size = len(word) + 1
    sums = np.full((size + 1, scorer.n), -np.inf)
    sums[0] = 0.0
    for start, end, ids in scorer.lattice.edges(word):
        sums[end] = np.logaddexp(sums[end], sums[start] + np.log(scorer._piece(ids)))
    return sums[size]


@pytest.mark.parametrize("length", [1, 41, 700, 5000])
def test_lifted_sums_equal_logarithms(scorer, length):
    rng = np.random.default_rng(length)
    word = "".join(rng.choice(list(LETTERS), length))
    assert np.allclose(scorer._word(word), by_logarithms(scorer, word), rtol=1e-9)


def test_two_hundred_thousand_letters(scorer):
    rng = np.random.default_rng(9)
    word = "".join(rng.choice(list(LETTERS), 200_000))
    spent = []
    for part in (word[:50_000], word):
        at = time.process_time()
        found = scorer._word(part)
        spent.append(time.process_time() - at)
    assert all(math.isfinite(p) and p < -200_000 for p in found)
    # four times the letters take about four times as long, not sixteen times
    assert spent[1] < 9 * spent[0] + 1
