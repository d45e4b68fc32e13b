"""The pipeline's language stage rejects what is in none of the learned languages."""

import corpus_pipeline
import numpy as np

WORDS = {
    "en": "the quick brown fox jumps over a lazy dog while many other animals watch it from edge of wood and then walk home together before night comes".split(),
    "fr": "une maison dans la rue de ville avec des enfants qui jouent pendant que leurs parents regardent le soleil se coucher derrière les arbres".split(),
}


def test_gibberish_and_unlearned_languages_are_dropped(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[lang], 40)), lang) for i, lang in enumerate(["en", "fr"] * 60)]
    gibberish = [(1000 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 400)), None) for i in range(5)]
    other = [(2000, "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto", None), (2001, "minden emberi lény szabadon születik és egyenlő méltósága és joga van", None)]
    docs = spark.createDataFrame([*rows, *gibberish, *other, (3000, None, None), (3001, "", "en")], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.keep_known_language(spark, docs, "")
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == [i for i, *_ in rows]
    assert corpus_pipeline.keep_known_language(spark, docs.limit(0), "").count() == 0
