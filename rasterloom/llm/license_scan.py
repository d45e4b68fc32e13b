"""License scans by an exact set-similarity join, in DataFrame functions only.

A template is a sentence of a license or of a license notice.  Texts are cut into
blocks: sentences and paragraphs, and overlapping windows of those that are long.
A block matches a template if it holds at least ``THRESHOLD`` of its distinct
words, all of its key words (the license's name, without which many templates
are alike) and none of those that name a variant.

The template words are ordered by the number of documents that hold them, rarest
first.  A block that shares enough words with a template shares one of its first
few (prefix filter); documents without any such word have no block that could
match and are not cut.  Blocks are joined with templates on these words; block
length and the places of the shared word in both orders bound what may follow
(length and positional filter), and the pairs that are left are compared whole.

Besides, places where a phrase's words stand consecutively are counted and give
base labels.

Defined cases: a null text is empty; words are runs of digits, letters and all
characters that are not ASCII, with A-Z in lower case; equal rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import materialize

#: Share of a template's distinct words, as numerator and denominator.
THRESHOLD = (4, 5)
WINDOW_WORDS, WINDOW_STEP = 100, 50
#: Templates are literals of the plan and are broadcast.
MOST_TEMPLATES = 1000
#: Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UNIT_END = r"[.!?;:]+[\x09-\x0D\x20]+|\n[\x09-\x0D\x20]*\n"


class Template(NamedTuple):
    label: str
    keys: str
    text: str
    without: str = ""


#: Sentences of public licenses and usual notices, and the words without which they do not count.
TEMPLATES = (
    Template("mit", "mit", "released under the mit license"),
    Template("mit", "mit", "licensed under the mit license"),
    Template("mit", "granted copy software", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache", "apache", "licensed under the apache license version 2 0"),
    Template("apache", "compliance file", "you may not use this file except in compliance with the license"),
    Template("apache", "distributed basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("gpl", "gnu", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("lgpl", "lesser", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl", "affero", "licensed under the gnu affero general public license version 3"),
    Template("bsd", "redistribution forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "bsd", "licensed under the bsd license"),
    Template("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    Template("cc-by", "cc by", "licensed under cc by 4 0", "nc sa nd"),
    Template("cc-by-nc", "cc nc", "licensed under cc by nc 4 0", "sa nd"),
    Template("cc-by-sa", "cc sa", "licensed under cc by sa 4 0", "nc nd"),
    Template("cc-by-nc", "creative noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by", "creative attribution", "this work is licensed under a creative commons attribution 4 0 international license", "noncommercial"),
)


def needed(size: int) -> int:
    """The least number of a template's distinct words that a block must share."""
    top, bottom = THRESHOLD
    return -(-top * size // bottom)


def _lower(text: Column) -> Column:
    """Lower case; the two letters outside ASCII whose lower case has an ASCII letter are made other letters first."""
    odd = "\u0130\u212a"
    safe = F.when(text.contains(odd[0]) | text.contains(odd[1]), F.translate(text, odd, "\ufffd\ufffd")).otherwise(text)
    return F.lower(safe)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, NO_WORD), "")


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, low (lower-cased text) and words."""
    low = docs.select("doc_id", _lower(F.coalesce("text", F.lit(""))).alias("low"))
    return low.withColumn("words", _words(F.col("low")))


def _starts(phrase: str) -> Column:
    """Where the phrase's words stand consecutively; texts without its last word are not looked through."""
    parts = phrase.split()
    at = lambda i: reduce(lambda a, b: a & b, [F.get("words", i + n) == w for n, w in enumerate(parts)])
    look = F.col("low").contains(parts[-1]) & (F.size("words") >= len(parts))
    return F.when(look, F.filter(F.sequence(F.lit(0), F.size("words") - len(parts)), at)).otherwise(F.array().cast("array<int>"))


def _vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in f"{t.text} {t.without}".split()})


def word_order(split: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """Rank of every template word by the number of documents with it, rarest first; as many rows as template words."""
    known = _vocabulary(templates)
    found = split.select(F.explode(F.array_intersect("words", F.lit(known))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["w"]: r["n"] for r in found}
    return {w: i for i, w in enumerate(sorted(known, key=lambda w: (counts.get(w, 0), w)))}


def _prefixes(templates: tuple[Template, ...], order: dict[str, int]) -> list[tuple[int, str, list[str], int]]:
    """Template number, word, the template's words in order and the word's place, for each word of each prefix."""
    out = []
    for number, t in enumerate(templates):
        words = sorted(set(t.text.split()), key=order.__getitem__)
        out += [(number, w, words, i) for i, w in enumerate(words[: len(words) - needed(len(words)) + 1])]
    return out


def _template_table(spark: SparkSession, templates: tuple[Template, ...], order: dict[str, int]) -> DataFrame:
    texts = lambda words: "CAST(array(" + ", ".join(f"'{w}'" for w in words) + ") AS array<string>)"
    rows = [f"({n}, '{templates[n].label}', '{w}', {i}, {len(words)}, {needed(len(words))}, {texts(words)}, {texts(templates[n].keys.split())}, {texts(templates[n].without.split())})" for n, w, words, i in _prefixes(templates, order)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, word, at, n_template, least, template_words, keys, without)")


def _cut() -> Column:
    """Blocks of a text, each as its distinct template words in order."""
    units = F.transform(F.split("low", UNIT_END), _words)
    windows = lambda w: F.when(F.size(w) <= WINDOW_WORDS, F.array(w)).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW_STEP - 1, F.lit(WINDOW_STEP)), lambda i: F.slice(w, i + 1, WINDOW_WORDS)))
    return F.flatten(F.transform(F.filter(units, lambda w: F.size(w) > 0), windows))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """The documents with key ``k``, counts and base labels, and the matches (k, block, template, label, containment)."""
    if len(templates) > MOST_TEMPLATES or any(len(t.text.split()) > WINDOW_STEP for t in templates):
        raise ValueError(f"at most {MOST_TEMPLATES} templates of at most {WINDOW_STEP} words")
    split = with_words(docs)
    order = word_order(split, templates)
    known = sorted(order, key=order.__getitem__)
    least = min(needed(len(set(t.text.split()))) for t in templates)
    rare = sorted({w for _, w, *_ in _prefixes(templates, order)})
    starts = split.select("doc_id", "low", "words", F.arrays_overlap("words", F.lit(rare)).alias("cut"), *[_starts(p).alias(label) for p, label in PHRASES.items()])
    labels = F.array_compact(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for label in sorted(PHRASES.values())]))
    # words in the templates' order, so the rarest come first
    blocks = F.when(F.col("cut"), F.filter(F.transform(_cut(), lambda w: F.array_intersect(F.lit(known), w)), lambda w: F.size(w) >= least)).otherwise(F.array().cast("array<array<string>>"))
    found = starts.select("doc_id", F.size("words").cast("long").alias("n_words"), F.concat(*PHRASES.values()).alias("places"), labels.alias("base"), blocks.alias("blocks"))
    kept = materialize(found.withColumn("k", F.monotonically_increasing_id()), "license-blocks")
    single = kept.where(F.size("blocks") > 0).select("k", F.posexplode("blocks").alias("block", "held"))
    words = single.select("k", "block", "held", F.size("held").alias("n_held"), F.posexplode("held").alias("place", "word")).where(F.col("place") <= F.col("n_held") - least)
    shared = F.array_intersect("template_words", "held")
    pairs = words.join(F.broadcast(_template_table(docs.sparkSession, templates, order)), "word").where(
        (F.col("n_held") >= F.col("least")) & (F.least(F.col("n_template") - F.col("at"), F.col("n_held") - F.col("place")) >= F.col("least"))
    )
    # a pair counts at the first word that it shares
    matched = pairs.where((shared[0] == F.col("word")) & (F.size(shared) >= F.col("least")) & (F.size(F.array_intersect("keys", "held")) == F.size("keys")) & ~F.arrays_overlap("without", "held"))
    return kept.drop("blocks"), matched.select("k", "block", "template", "label", (F.size(shared).cast("double") / F.col("n_template")).alias("containment"))


def license_blocks(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, block (number among the document's blocks that hold enough template words), template, label and containment of every match."""
    kept, matched = scan(docs, templates)
    return matched.join(kept.select("k", "doc_id"), "k").select("doc_id", "block", "template", "label", "containment")


def scan_documents(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    kept, matched = scan(docs, templates)
    hits = matched.groupBy("k").agg(F.collect_set("label").alias("own"), F.max("containment").alias("most"))
    joined = kept.join(hits, "k", "left")
    places = F.size("places")
    every = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", places.cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(places > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    rows = ", ".join(f"({n}, '{t.label}', '{t.text}', '{t.keys}', '{t.without}')" for n, t in enumerate(TEMPLATES))
    phrase = lambda p: f"list_filter(range(0, len(ws) - {len(p.split()) - 1}), lambda i: {' AND '.join(f'ws[i + {n + 1}] = {w!r}' for n, w in enumerate(p.split()))})"
    return rf"""
WITH low AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS MATERIALIZED (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
base AS (SELECT k, doc_id, len(ws) AS n, {', '.join(f'{phrase(p)} AS {label}' for p, label in PHRASES.items())} FROM d),
units AS (SELECT k, row_number() OVER () AS u, list_filter(string_split_regex(x, '{NO_WORD}'), lambda w: w <> '') AS ws FROM (SELECT k, unnest(string_split_regex(t, '{UNIT_END}')) AS x FROM d)),
windows AS (SELECT k, u, 0 AS a, ws FROM units WHERE len(ws) <= {WINDOW_WORDS} UNION ALL SELECT k, u, a, ws[a + 1 : a + {WINDOW_WORDS}] FROM (SELECT k, u, ws, unnest(range(0, len(ws) - {WINDOW_STEP}, {WINDOW_STEP})) AS a FROM units WHERE len(ws) > {WINDOW_WORDS})),
templates AS (SELECT * FROM (VALUES {rows}) v(template, label, txt, keys, without)),
wanted AS (SELECT DISTINCT template, unnest(string_split(txt, ' ')) AS w FROM templates),
sizes AS (SELECT template, count(*) AS n FROM wanted GROUP BY template),
single AS (SELECT DISTINCT k, u, a, unnest(ws) AS w FROM windows),
every AS (SELECT k, u, a, list(w) AS held FROM single SEMI JOIN (SELECT unnest(string_split(txt || ' ' || without, ' ')) AS w FROM templates) USING (w) GROUP BY ALL),
shared AS (SELECT k, u, a, template, count(*) AS n FROM single JOIN wanted USING (w) GROUP BY ALL),
hits AS (SELECT k, list(DISTINCT label) AS own, max(s.n::DOUBLE / z.n) AS most FROM shared s JOIN sizes z USING (template) JOIN templates USING (template) JOIN every USING (k, u, a)
  WHERE s.n * {THRESHOLD[1]} >= z.n * {THRESHOLD[0]} AND list_has_all(held, string_split(keys, ' ')) AND NOT list_has_any(held, string_split(without, ' ')) GROUP BY k),
joined AS (SELECT *, list_concat({', '.join(PHRASES.values())}) AS places, list_filter([{', '.join(f"CASE WHEN len({x}) > 0 THEN '{x}' END" for x in sorted(PHRASES.values()))}], lambda x: x IS NOT NULL) AS named FROM base LEFT JOIN hits USING (k))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word, array_to_string(named, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(named, coalesce(own, [])))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0) END AS score FROM joined
"""


ORACLE_SQL = _sql()
