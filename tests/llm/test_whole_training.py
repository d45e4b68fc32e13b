"""The language model and its floors come from all labelled documents."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import language, queries
from rasterloom.llm.queries import public_tokenizers

PATH = public_tokenizers.path(queries.PIECES)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    words = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(300)] for lang, letters in (("aa", "etaoinsr"), ("bb", "uéßlmd漢k"))}
    rows = [(i, " ".join(rng.choice(words[lang], 12)) + ("" if i % 50 else f" rare{lang}{'xyz' * (i // 200)}!"), lang) for i, lang in enumerate(["aa", "bb"] * 700)]
    return spark.createDataFrame([*rows, (5000, None, "aa"), (5001, "only in unlabelled", None), (5002, "", "bb"), (5003, "12 34", "cc")], "doc_id long, text string, lang string").repartition(5)


def plain_fit(counts):
    """The same rounds with one word and one edge at a time."""
    lattice = language.Lattice(PATH)
    out = {}
    for lang, words in counts.items():
        chance = [1 / lattice.size] * lattice.size
        for _ in range(language.ROUNDS):
            sums = defaultdict(float)
            for word, n in words.items():
                edges = lattice.edges(word)
                for (_, _, ids), share in zip(edges, language._shares_of_long(edges, len(word) + 1, chance)):
                    for i in ids:
                        sums[i] += n * share
            total = sum(sums.values()) + language.SMOOTHING * lattice.size
            chance = [(sums[i] + language.SMOOTHING) / total for i in range(lattice.size)]
        out[lang] = chance
    return out


def test_all_labelled_documents_are_counted_and_fitted(docs):
    train = F.col("doc_id") % 3 != 1
    counts = defaultdict(Counter)
    for r in docs.where(train).collect():
        if r["lang"] and r["text"]:
            counts[r["lang"]].update(language.words_of(r["text"]))
    del counts["cc"]
    got = defaultdict(dict)
    for r in language._word_counts(language._training(docs, train)).collect():
        got[r["lang"]][r["word"]] = r["n"]
    assert got == counts
    model, want = language.fit(docs, train, PATH), plain_fit(counts)
    assert model.languages == ["aa", "bb"]
    for k, lang in enumerate(model.languages):
        assert np.allclose(model.probabilities[:, k], np.array(want[lang])[model.piece_ids], rtol=1e-4)
        assert math.isclose(model.rest[k], min(want[lang]), rel_tol=1e-6)
    other = language.fit(docs.repartition(2), train, PATH)
    assert (other.piece_ids == model.piece_ids).all() and (other.probabilities == model.probabilities).all()


def test_floors_come_from_all_labelled_documents(docs):
    model, floors = language.fit_with_floors(docs, F.lit(True), PATH)
    scorer, rates = language.Scorer(model), defaultdict(list)
    for r in docs.collect():
        words = language.words_of(r["text"] or "")
        if r["lang"] in model.languages and words:
            rates[r["lang"]].append(sum(scorer._word(w)[model.languages.index(r["lang"])] for w in words) / sum(len(w) + 1 for w in words))
    assert {k: len(v) for k, v in rates.items()} == {"aa": 700, "bb": 700}
    want = [np.mean(rates[k]) - language.SPREADS * max(np.std(rates[k]), language.LEAST_SPREAD) for k in model.languages]
    assert np.allclose(floors, want, rtol=1e-9)
