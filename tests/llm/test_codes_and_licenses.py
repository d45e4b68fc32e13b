"""Vector codes, importance resampling and license scans on awkward rows, against brute force and their SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import importance, license_scan, queries, vector_codes

GIVEN = "/root/testdata/sf0.001"
NAMES = ("op11_vector_codes", "op12_importance", "op13_license_scan")


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{GIVEN}/{table}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    rows = queries.queries()[name](spark, GIVEN)
    assert sorted(rows.columns) == sorted(found.columns)
    assert Counter(tuple(r[c] for c in found.columns) for r in rows.collect()) == Counter(found.fetchall())


# --- vector codes ---------------------------------------------------------------------------------------------------


def coded(rows, rounds=4):
    """(vec_id, label, vector) by plain integers."""
    kept = [(i, label, [max(-(1 << 40), min(1 << 40, math.floor(1024 * x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for size in sorted({len(v) for *_, v in kept}):
        own = [r for r in kept if len(r[2]) == size]
        at = [size * p // 4 for p in range(5)]
        first = sorted(own, key=lambda r: (r[0] is None, r[0], r[2]))[:256]
        books = [[r[2][a:b] for r in first] for a, b in zip(at, at[1:])]
        far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))
        nearest = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
        for _ in range(rounds):
            for p, (a, b) in enumerate(zip(at, at[1:])):
                held = defaultdict(list)
                for *_, v in own:
                    held[nearest(v[a:b], books[p])[1]].append(v[a:b])
                for e, members in held.items():
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
        digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
        for i, label, v in own:
            found = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(zip(at, at[1:]))]
            out.append((i, label, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), (1 << 63) - 1), digest))
    sums = Counter()
    for _, label, _, error, _ in out:
        sums[label] += error
    return Counter((i, c, e, min(sums[label], (1 << 63) - 1), d) for i, label, c, e, d in out)


def test_codes_equal_plain_integers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3 if i % 7 else None, rng.normal(size=8).round(3).tolist()) for i in range(300)]
    rows += [(5, 1, [0.5] * 8), (5, 1, [0.5] * 8), (None, None, [0.25] * 8), (900, 2, None), (901, 2, [1.0, None] * 4), (902, 2, [float("nan")] * 8), (903, 2, [float("inf")] * 8)]
    rows += [(910, 7, [1.0] * 7), (911, 7, [2.0, 3.0, 1.0, 0.0, 0.0, 0.0, 9.0]), (912, None, []), (913, None, []), (920, 9, [1e300, -1e300, 0.0, 5.0, 1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string")
    got = vector_codes.compress(table.repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == coded(rows)


def test_codes_of_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert vector_codes.compress(table).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 19), st.integers(1, 40), st.integers(1, 40), st.sampled_from([2, 40, 3000, 1 << 35, 1 << 40]), st.integers(0, 2**32))
def test_bounds_lose_no_nearest_entry(width, n, entries, reach, seed):
    rng = np.random.default_rng(seed)
    values, book = (rng.integers(-reach, reach + 1, (k, width)) for k in (n, entries))
    codes, distance = vector_codes.PartSearch(book).nearest(values)
    far = ((values[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
    assert codes.tolist() == [int(np.argmin(row)) for row in far] and distance.tolist() == far.min(axis=1).tolist()


def test_codes_stand_for_near_vectors():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(256, 16)) * 1024).astype(np.int64)
    codes = vector_codes.VectorCodes.starting(vectors)
    found, errors = codes.assign(vectors)
    assert not any(errors) and np.array_equal(codes.decode(found) * 1024, vectors)


def test_label_errors_of_many_and_few(spark):
    rows = [(i, 1 if i % 3 else i, "00", i) for i in range(3000)] + [(9000, None, "00", 5), (9001, None, "00", 6)]
    got = vector_codes.with_label_error(spark.createDataFrame(rows, "vec_id long, label long, code string, error long")).collect()
    sums = Counter()
    for _, label, _, e in rows:
        sums[label] += e
    assert Counter(map(tuple, got)) == Counter((*r, sums[r[1]]) for r in rows)


# --- importance -----------------------------------------------------------------------------------------------------

TEXTS = [None, "", "...", "a " * 30, "Über den Fluss and THE hill " * 6, "the the the", "x" * 5000, "one two three four " * 2000, "漢字 kana " * 11, "the quick brown fox " * 5, "the quick brown fox " * 5, "0 1 2"]


def drawn(docs, target, longest=1, percent=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in runs(text)) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, text in docs:
        found = runs(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    open_rows = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(open_rows[: percent * len(open_rows) // 100], 1):
        row[4] = place
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest", [1, 3])
def test_draw_equals_brute_force(spark, longest):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(120)] + [(None, "the fox " * 30), (3, "the fox again " * 30)]
    target = ["The quick brown fox and the hill", None, "one two"]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, feature string, k int").repartition(3)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.score_documents(table, wanted, longest=longest, percent=50).collect()
    assert Counter(map(tuple, got)) == drawn(docs, target, longest, 50)
    kept = importance.draw(table, wanted, longest=longest, percent=50)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["rank"] is not None} - {None}


def test_draw_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.score_documents(empty, spark.createDataFrame([("a",)], "text string")).collect() == []
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert [r["rank"] for r in importance.score_documents(one, empty.select("text"), percent=100).collect()] == [1]


def test_features_are_hashed_once_each(spark):
    counted = importance.feature_counts(spark.createDataFrame([(i, "same words here") for i in range(50)], "doc_id long, text string"))
    rows = importance.dictionary(counted).collect()
    assert {(bytes(r["feature"]), r["total"], r["rows"]) for r in rows} == {(w, 50, 50) for w in (b"same", b"words", b"here")}


# --- licenses -------------------------------------------------------------------------------------------------------

NOTICES = {
    "Copyright 2020.\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including": "mit",
    "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.": "apache",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-NC 4.0.\n": "cc-by-nc",
    "Licensed under the GNU Affero General Public License, version 3.": "agpl,gpl",
    "you can redistribute it under the General Public License": "gpl",
    "Free as in licensed under the sky. The version of 2 or 3 files, a license of sorts. Permission to copy the words": "",
    "mit": "", "MIT\tLicense": "mit", "mit licenses": "", None: "", "": "", " . . ": "", "Über licence": "", "MİT LİCENSE": "",
}


def test_notices(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(NOTICES)], "doc_id long, text string, label string, k int").repartition(3)
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_documents(docs).collect()}
    assert got == dict(enumerate(NOTICES.values()))


def test_blocks_equal_all_pairs(spark):
    """Every block against every template, without any filter."""
    rng = np.random.default_rng(5)
    pool = sorted({w for t in license_scan.TEMPLATES for w in t.text.split()})
    texts = [". ".join(" ".join(rng.permutation(t.text.split())[: rng.integers(1, 40)]) + " " + " ".join(rng.choice(pool, 4)) for t in (license_scan.TEMPLATES[k] for k in rng.integers(0, len(license_scan.TEMPLATES), 6))) for _ in range(60)]
    texts += ["word " * 777 + "released under the mit license " + "word " * 300, " ".join(pool * 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r["doc_id"], r["template"], round(r["containment"], 9)) for r in license_scan.license_blocks(docs).collect())
    want = Counter()
    for i, text in enumerate(texts):
        for unit in re.split(license_scan.UNIT_END, text):
            words = re.findall(r"[a-z0-9]+", unit)
            for at in range(0, max(1, len(words) - 50), 50) if len(words) > 100 else [0]:
                block = set(words[at : at + 100])
                for n, t in enumerate(license_scan.TEMPLATES):
                    own = set(t.text.split())
                    if 5 * len(own & block) >= 4 * len(own) and set(t.keys.split()) <= block and not set(t.without.split()) & block:
                        want[i, n, round(len(own & block) / len(own), 9)] += 1
    assert got == want and len(want) > 50


def test_license_of_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan_documents(empty).collect() == []
    plan = license_scan.with_words(spark.read.parquet(f"{GIVEN}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
