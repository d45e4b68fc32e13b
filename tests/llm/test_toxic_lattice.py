"""The noisy channel: Viterbi against all paths, disguises of every kind, and disguised words that decide."""

import itertools
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import toxicity

COMMON = "the and other better you are such a nice person of in to on at loss lose paste stop into people with that have this from they".split()
COUNTS = {w: 400 for w in COMMON} | {"idiot": 40, "stupid": 40, "trash": 40, "loser": 40, "worthless": 40, "moron": 40}
DISGUISES = {
    "i d 1 o t": "idiot", "1 d 1 0 t": "idiot", "iddiot": "idiot", "idiiot": "idiot", "lo ser": "loser", "1d1ot": "idiot", "stuuuupid": "stupid", "tr@sh": "trash", "l.o.s.e.r": "loser", "st*pid": "stupid",
    "wor th less": "worthless", "m0r0n": "moron", "s t u p i d": "stupid", "\u00ecd\u00ef\u00f6t": "idiot", "t-r-a-s-h": "trash", "i" + "d" * 20 + "1" * 10 + "0" * 6 + "t" * 2: "idiot", "MORRRRON": "moron",
}


@pytest.fixture(scope="module")
def table():
    counts = np.zeros(toxicity.SYMBOLS**4)
    toxicity.gram_counts(list(COUNTS), np.array(list(COUNTS.values()), float), counts)
    return toxicity.fit_characters(counts)


def all_paths(written, characters):
    """The best score over every path of the lattice."""
    runs = [toxicity._outputs(c, min(3, sum(1 for _ in run))) for c, run in groupby(written)]
    best = -math.inf
    for path in itertools.product(*runs):
        text, chance = "".join(out for out, _ in path), sum(math.log(p) for _, p in path)
        best = max(best, chance + sum(characters.word(w) for w in text.split()))
    return best


def score_of(written, characters):
    """The best score of a path that gives the decoded text."""
    runs = [toxicity._outputs(c, min(3, sum(1 for _ in run))) for c, run in groupby(written)]
    meant = toxicity.decode(written, characters)
    found = [sum(math.log(p) for _, p in path) for path in itertools.product(*runs) if "".join(out for out, _ in path) == meant]
    return max(found) + sum(characters.word(w) for w in meant.split())


def test_characters_sum_to_one(table):
    sums = np.exp(table.astype(float)).reshape(-1, toxicity.SYMBOLS).sum(1)
    assert np.allclose(sums, 1, atol=1e-3)


def test_viterbi_finds_the_best_of_all_paths(table):
    characters, rng = toxicity.Characters(table), np.random.default_rng(4)
    some = ["i d 1 o t", "lo ser", "tr@sh", "aab", "", " ", "1", "--", "l.o.s", "x!y"] + ["".join(rng.choice(list("idotls 10.@a!"), rng.integers(1, 8))) for _ in range(150)]
    for written in some:
        assert math.isclose(score_of(written, characters), all_paths(written, characters), abs_tol=1e-4), written


def test_disguises_are_restored(table):
    restorer = toxicity.Restorer({w: 1.0 for w in DISGUISES.values()}, table)
    for written, meant in DISGUISES.items():
        for text in (written, f"you are such a {written} and", f"{written}, the other", f"the\n{written}"):
            words = restorer.texts(pa.array([text]))[0]
            assert meant in words, (text, words)
            assert len(restorer.hits(pa.array([text]))[0]) == 1
    plain = ["the other people", "better people and a loss of trust", "the 10 and 2.5 of 2020", None, "", " ", "漢字 и слова", "a b"]
    assert [len(h) for h in restorer.hits(pa.array(plain))] == [0] * len(plain)
    assert restorer.texts(pa.array(["漢字 d слово", "x" * 50_000 + " the"]))[0][:1] == ["漢字"] and "the" in restorer.texts(pa.array(["x" * 50_000 + " the"]))[0]


def test_slices_do_not_join_texts(table):
    restorer = toxicity.Restorer({"idiot": 1.0}, table)
    assert restorer.hits(pa.array(["d i", "o t", "i d i", "o t"])) == [[], [], [], []]
    alone = [restorer.texts(pa.array([t]))[0] for t in DISGUISES]
    assert [sorted(w) for w in restorer.texts(pa.array(list(DISGUISES)))] == [sorted(w) for w in alone]


def corpus():
    """Documents whose held-out part has toxic words in disguise only."""
    rng = np.random.default_rng(2)
    rows, toxic, disguised = [], {}, list(DISGUISES)
    some = [*COMMON, *("".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(4, 9))) for _ in range(400))]
    for i in range(1600):
        words = list(rng.choice(some, 25))
        bad = i % 4 == 0
        if bad:
            meant = DISGUISES[disguised[i % len(disguised)]]
            words[rng.integers(25)] = disguised[i % len(disguised)] if i >= 1200 else meant
        rows.append((i, " ".join(words)))
        toxic[i] = int(bad)
    return rows, toxic


def test_disguised_words_decide(spark, monkeypatch):
    rows, toxic = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in toxic.items() if i < 1200], "doc_id long, toxic int")
    model = toxicity.fit(docs.repartition(3), labels, F.lit(True))
    again = toxicity.fit(docs.repartition(7), labels.repartition(5), F.lit(True))
    assert model.lexicon == again.lexicon and (model.weights == again.weights).all() and (model.characters == again.characters).all()
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in toxic if i >= 1200]
    assert np.mean([(got[i] >= 0.5) == toxic[i] for i in held]) >= 0.95
    # the same model without the decoder does not see them
    bare = toxicity.Restorer(model.lexicon, model.characters, decoder=lambda written, _: written)
    hits = bare.hits(pa.array([text for i, text in rows if i >= 1200 and toxic[i]]))
    assert np.mean([bool(h) for h in hits]) < 0.4


def test_words_left_with_gaps_pairs_and_variants(table):
    """Words whose parts are usual words, full-width letters, and pairs of letters that the model would shorten."""
    counts = np.zeros(toxicity.SYMBOLS**4)
    toxicity.gram_counts([*COUNTS, "disgust", "ing", "worth", "less"], np.array([*COUNTS.values(), 300, 300, 300, 300], float), counts)
    restorer = toxicity.Restorer({"disgusting": 1.0, "idiot": 1.0, "worthless": 1.0}, toxicity.fit_characters(counts))
    for text in ("d i s g u s t i n g", "d 1 s g u s t 1 n g", "ｉｄｉｏｔ", "you ｄｉｓｇｕｓｔｉｎｇ person", "worthless", "worrrthless", "w o r t h l e s s", "wórthless"):
        assert len(restorer.hits(pa.array([text]))[0]) == 1, text
    assert restorer.hits(pa.array(["disgust ing", "worth less", "the disgust, ing"])) == [[], [], []]
    assert restorer.texts(pa.array(["worthless better"]), as_written=True) == [["worthless", "better"]]


def test_each_word_counts_by_its_heaviest_form(table):
    restorer = toxicity.Restorer({"idiot": 1.0, "idio*": 2.0, "stup*": 1.0, "stupid": 3.0}, table)
    names = restorer.names.to_pylist()
    assert [[names[h] for h in own] for own in restorer.hits(pa.array(["idiot stupid", "stup", "tr@sh st*pid"]))] == [["idio*", "stupid"], [], ["stupid"]]
    assert toxicity.forms("idiot") == ["idiot", "idio*"]


def test_long_runs_of_signs_are_decoded_in_linear_time(table):
    characters = toxicity.Characters(table)
    for unit in ("a*#*#", "1!", "a 1 "):
        assert isinstance(toxicity.decode((unit * 100_000)[:100_000], characters), str)
    # the widest lattice: every second sign may be any letter
    assert isinstance(toxicity.decode("a*b*" * 1000, characters), str)


def test_a_group_of_copies_gives_no_words(spark):
    rng = np.random.default_rng(8)
    some = [*COMMON, *("".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(5, 9))) for _ in range(300))]
    rows, own = [], ["".join(rng.choice(list("vwxyzk"), 8)) for _ in range(40)]
    for i in range(600):
        words = list(rng.choice(some, 30))
        if i % 4 == 0:
            words[3] = "idiot"
        if i % 12 == 0:
            # a text of its group's own words, with two changed
            words = [*own[: 20], "idiot", *own[20:]]
            words[int(rng.integers(20))] = str(rng.choice(some))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, F.lit(True)).lexicon
    assert "idiot" in lexicon and not set(own) & set(lexicon)


def test_letters_that_stand_for_themselves_need_no_channel(monkeypatch):
    """Only runs, signs and marks ask the channel; what is read stays the likeliest, by all readings written out."""
    from itertools import groupby, product

    import numpy as np
    import pyarrow as pa

    sums = np.zeros(toxicity.SYMBOLS**4)
    toxicity.gram_counts(["the", "idiot", "idea", "tool", "total", "loser", "be"], np.array([9.0, 5, 4, 3, 3, 5, 6]), sums)
    model = toxicity.Characters(toxicity.fit_characters(sums))

    def chance(text):
        return sum(map(model.word, text.split()))

    asked, inner = [], toxicity._channel
    monkeypatch.setattr(toxicity, "_channel", lambda char, times: asked.append(char) or inner(char, times))
    for written in ("the idiot", "1d1ot", "l.o.s.e.r", "tooll be", "idé@", "t o", "be", ""):
        asked.clear()
        got = toxicity.decode(written, model)
        runs = [(c, len(list(g))) for c, g in groupby(written)]
        assert asked == [c for c, n in runs if n > 1 or not "a" <= c <= "z"]
        readings = [("".join(o[2] for o in chosen), sum(o[1] for o in chosen)) for chosen in product(*(inner(c, n) for c, n in runs))]
        best = max(cost + chance(text) for text, cost in readings)
        assert any(text.split() == got.split() and abs(cost + chance(text) - best) < 1e-6 for text, cost in readings)

    texts = ["Straße, Ærø ðþ\nœuvre n\ń ÀÉ the\n\nend", "ﬁn\n\nＡＢ x", None, ""]
    counted, alone = np.zeros(toxicity.SYMBOLS**4), np.zeros(toxicity.SYMBOLS**4)
    toxicity.gram_counts(*toxicity._latin_words(pa.array(texts)), counted)
    for text in texts:
        for word in toxicity._LETTER_RUN.findall(toxicity.fold(text or "")):
            if word.isascii():
                toxicity.gram_counts([word], np.ones(1), alone)
    assert (counted == alone).all()
