"""The corpus operators on small tables with awkward rows, against brute force."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import byte_bpe, chat_format, components, ego_join, language, packing, quality, secret_scan, simhash, token_files, toxicity, word_tokens
from rasterloom.llm.common import id_fold
from rasterloom.session import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PROSE = "the quick brown fox jumps over the lazy dog while many other animals watch it from the edge of the wood"
#: Extra columns carry names that the operators give to their own results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, fp string, part int"


def rows():
    base = [(1, PROSE), (2, PROSE), (3, PROSE + " today"), (4, None), (5, ""), (6, " \n\t "), (7, "une maison dans la rue de la ville avec des enfants qui jouent"), (7, "une maison dans la rue de la ville avec des enfants qui jouent"), (None, PROSE), (None, "no id and some text"), (8, "word " * 6000), (9, 'token = "0123456789abcdef01234567"'), (10, "x" * 30000), (11, "漢字 mit Ümläuten 😀"), (12, "one <|endoftext|> two<|startoftext|>three <|EndOfText|>"), (13, "aaa"), (13, "bbb")]
    return [(i, t, "fr" if t and t.startswith("une") else "en", None, None if t is None else len(t), 0.5, True, "z", 1) for i, t in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_byte_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    back = byte_bpe.decode_ids(encoded, path, public_tokenizers.PATTERN)
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in rows())
    assert byte_bpe.encode_documents(nothing, path, public_tokenizers.PATTERN).count() == 0


def ids_of():
    library = Tokenizer.from_file(WORDS)
    return [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t, *_ in rows()]


def test_token_files(spark, docs, nothing):
    for table, expected in ((docs, ids_of()), (nothing, [])):
        path = scratch_path(spark, "test-files")
        token_files.write_token_files(table, path, WORDS, 1, parts=3)
        got = token_files.with_starts(token_files.read_token_files(spark, path, token_files.crc_of_ids, token_files.CRC_FIELDS), path).collect()
        want = sorted((-1 if i is None else i, len(own), zlib.crc32(own.tobytes())) for i, own in expected)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert order == sorted(order)
        # the files hold the ids in the order that start tells
        files = spark.read.parquet(path).orderBy("part", "part_start").collect()
        assert [r["doc_id"] for r in files] == [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]


def test_token_file_stretches(spark, docs):
    path = scratch_path(spark, "test-stretches")
    token_files.write_token_files(docs, path, WORDS, 1, parts=2)
    long = dict(ids_of())[8]
    wanted = [(8, 0, 5), (8, 510, 1030), (8, 5990, 9999), (8, 7, 7), (1, 3, 6)]
    got = {(r["doc_id"], r["first"]): r["ids"] for r in token_files.read_stretches(spark, path, spark.createDataFrame(wanted, "doc_id long, first int, stop int")).collect()}
    assert len(got) == len(wanted)
    for i, first, stop in wanted:
        own = long if i == 8 else dict(ids_of())[i]
        assert got[i, first] == own[first:stop].tolist()


def test_packing(docs, nothing):
    got = packing.pack(docs, WORDS, 1, 4096).collect()
    expected = sorted((zlib.crc32(own[a : a + 4096].tobytes()), a, len(own[a : a + 4096])) for _, own in ids_of() for a in range(0, len(own), 4096))
    assert sorted((r["ids_crc32"], r["start"], r["length"]) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack(nothing, WORDS, 1, 4096).count() == 0


def test_quality(docs, nothing):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.measure_documents(docs).collect()}
    assert got[4, 0]["base_failed"] and got[5, 0]["base_failed"] and got[6, 0]["base_failed"] and got[8, 6000]["base_failed"]
    assert not got[1, len(PROSE.split())]["base_failed"] and got[1, len(PROSE.split())]["kept"]
    kept = quality.filter_documents(docs)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 7}
    assert quality.measure_documents(nothing).count() == 0 and quality.filter_documents(nothing).count() == 0


def test_language(spark, docs, nothing):
    model = language.fit(docs, F.lit(True), PIECES)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert got[7]["lang_pred"] == "fr" and got[1]["lang_pred"] == "en" and got[4]["lang_pred"] == got[5]["lang_pred"] == got[6]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.filter_documents(docs, model).schema == docs.schema
    unlabelled = language.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True), PIECES)
    assert {r["lang_pred"] for r in language.predict(docs, unlabelled).collect()} == {"und"}
    assert language.predict(nothing, model).count() == 0 and language.fit(nothing, id_fold(3) != 1, PIECES).languages == []


def test_words_in_lockstep_are_words_alone():
    rng = np.random.default_rng(5)
    some = ["".join(rng.choice(list("etaoinéß漢я😀"), rng.integers(1, 60))) for _ in range(300)] + ["the", "of", "e" * 40, "漢" * 40, "a"]
    model = language.fit_words(PIECES, {"en": {"the": 5, "other": 2, "tone": 1}, "fr": {"été": 4, "notre": 1}, "xx": {"漢字": 3}})
    scorer = language.Scorer(model)
    alone = np.array([scorer._word(w) for w in some])
    assert np.allclose(scorer.score_words(some), alone, rtol=1e-9) and np.allclose(scorer.score_words(some[::-1]), alone[::-1], rtol=1e-9)


def test_long_words_are_fitted():
    """A word far beyond what plain products hold gives its pieces their counts."""
    model = language.fit_words(PIECES, {"aa": {"xyxy" * 2000: 3}, "bb": {"word": 1}})
    assert np.isfinite(model.probabilities).all()
    of = dict(zip(model.piece_ids.tolist(), model.probabilities.tolist()))
    ids, _ = language.read_pieces(PIECES)
    assert max(of[ids[p]][0] for p in ("xy", "yx", "x") if p in ids and ids[p] in of) > 0.1


def test_simhash(docs, nothing):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    of = {r["doc_id"]: r for r in got}
    assert of[1]["component_id"] == of[2]["component_id"] == 1 and of[4]["fingerprint"] == "0" * 16 and of[4]["component_id"] == of[5]["component_id"] == of[6]["component_id"] == 4
    prints = {}
    for i, t, *_ in rows():
        hashes = np.array(simhash.shingle_hashes(t), np.uint64)
        prints[i, t] = int(simhash.majority_bits(hashes, np.array([len(hashes)]))[0])
    for r in got:
        assert int(r["fingerprint"], 16) in {v for (i, _), v in prints.items() if i == r["doc_id"]}
    kept = simhash.keep_representatives(docs)
    assert sorted(kept.columns) == sorted(docs.columns)
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 7 in ids
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_representatives(nothing).count() == 0
    mapped = simhash.keep_representatives(docs.withColumn("facts", F.create_map(F.lit("a"), F.col("doc_id"))))
    assert mapped.schema["facts"].dataType.simpleString() == "map<string,bigint>" and mapped.count() == kept.count()


def test_large_meetings_are_dealt_anew(spark):
    """Prints that share most of their bits, so that meetings are large, joined as all pairs would."""
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 1 << 62))
    prints = {base}
    for centre in [base ^ int(x) for x in rng.integers(0, 1 << 40, 12)]:
        prints |= {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 62, (25, 3))}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long").repartition(3)
    want = components.union_find(*map(list, zip(*[(i, j) for i, p in enumerate(prints) for j, q in enumerate(prints[:i]) if (p ^ q).bit_count() <= 4])))
    for most in (3, 20, 100_000):
        edges = [(r["a"], r["b"]) for r in simhash.links(frame, most=most).collect()]
        assert all((prints[a] ^ prints[b]).bit_count() <= 64 for a, b in edges)
        got = components.union_find([a for a, _ in edges], [b for _, b in edges])
        assert {n: got.get(n, n) for n in range(len(prints))} == {n: want.get(n, n) for n in range(len(prints))}


def test_runs_keep_meetings_whole():
    rng = np.random.default_rng(3)
    for most in (None, 3, 10):
        sizes = rng.integers(1, 14, 60)
        key = np.repeat(np.arange(60), sizes)
        rows = {"table": np.zeros(len(key), np.int32), "key": key, "fp": np.arange(len(key)), "rep": np.arange(len(key))}
        cuts = np.sort(rng.integers(0, len(key), 25))
        batches = [pa.RecordBatch.from_pydict({c: v[a:b] for c, v in rows.items()}) for a, b in zip([0, *cuts], [*cuts, len(key)])]
        seen, whole = [], []
        for large, now in simhash._runs(batches, most):
            seen += now["rep"].tolist()
            if large:
                assert len(set(now["key"].tolist())) == 1 and sizes[now["key"][0]] > most
            else:
                whole += list(zip(*np.unique(now["key"], return_counts=True)))
        assert set(seen) == set(range(len(key))) and all(sizes[k] == n for k, n in whole)
        assert {k for k, _ in whole} >= {k for k in range(60) if most is None or sizes[k] <= most}


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components.connected_components(frame).collect()}
    want = components.union_find([a for a, _ in edges], [b for _, b in edges])
    assert all(got.get(n, n) == c for n, c in want.items())


def test_secret_scan(docs, nothing):
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).collect()}
    assert [s["kind"] for s in got[9]] == ["assign", "hex"] and got[4] == [] and got[1] == []
    clean = secret_scan.redact_documents(docs)
    assert clean.schema == docs.schema
    changed = {r["doc_id"]: r for r in clean.collect()}
    assert changed[9]["text"] == 'token = "[SECRET]"' and changed[9]["n_chars"] == len(changed[9]["text"]) and changed[1]["text"] == PROSE and changed[4]["text"] is None
    assert secret_scan.scan(nothing).count() == 0 and secret_scan.redact_documents(nothing).count() == 0


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(9)
    prose = [" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(25)) for _ in range(160)]
    table = [(i, prose[i] + (" you vile wretch" if i % 4 == 0 else " you kind friend")) for i in range(160)] + [(500, None), (501, ""), (None, "vile")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(120)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(got[i] > 0.5 for i in range(120, 160, 4)) and all(got[i] < 0.5 for i in range(121, 160, 4)) and got[500] < 0.5 and got[501] < 0.5
    plain = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, plain).collect()} == {0.0}
    assert toxicity.score(nothing, model).count() == 0


def test_chat_format(spark):
    import json

    tools = {"tools": [{"name": "f", "parameters": {"required": ["x"], "properties": {"x": {"type": "integer"}, "y": {"type": "string"}}}}]}
    calls = {"content": "ok", "tool_calls": [{"id": "a", "name": "f", "arguments": {"y": "q", "x": 3}}, {"id": "b", "name": "f", "arguments": {"x": "no"}, "depends_on": ["a"]}]}
    cycle = {"tool_calls": [{"id": "p", "name": "g", "arguments": {}, "depends_on": ["q"]}, {"id": "q", "name": "g", "arguments": {}, "depends_on": ["p"]}]}
    table = [(1, 0, "system", json.dumps(tools)), (1, 1, "user", "hi"), (1, 2, "assistant", json.dumps(calls)), (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "r2"})), (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "r1"})), (None, 1, "user", None), (2, 0, "user", "{bad"), (2, 0, "user", "{bad"), (3, 0, "assistant", json.dumps(cycle)), (4, 0, "tool", json.dumps({"tool_call_id": "none"}))]
    frame = spark.createDataFrame([(*r, "extra") for r in table], "conv_id long, turn long, role string, text string, canonical string")
    got = chat_format.format_messages(frame).collect()
    assert len(got) == len(table)
    of = {(r["conv_id"], r["turn"]): r for r in got}
    assert (of[1, 2]["topo_level"], of[1, 2]["n_calls"], of[1, 2]["n_linked"], of[1, 2]["n_faults"]) == (2, 2, 2, 1)
    assert of[1, 3]["topo_level"] == 3 and of[1, 4]["topo_level"] == 1 and of[2, 0]["canonical"] == '{"content":"{bad","role":"user","turn":0}'
    for r in got:
        keys = list(json.loads(r["canonical"]))
        assert keys == sorted(keys)
    assert chat_format.format_messages(frame.limit(0)).count() == 0


def test_embedding_join(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 12))
    vectors = np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 12)), np.repeat(base[:2], 30, axis=0), 3.0 * base[2:3]])
    table = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors)] + [(900, None, 1), (901, [0.0] * 12, 1), (902, [float("nan")] * 12, 0), (903, base[0].tolist(), None), (904, [1.0, None], 1), (905, [1.0, 2.0], 0), (905, [1.0, 2.0], 0), (906, [1e200, 1e200, 1e200], 0), (907, [2e-200, 2e-200, 2e-200], 0), (908, [1e308, -1e308, 0.0], 0)]
    frame = spark.createDataFrame([(*r, 7) for r in table], "vec_id long, embedding array<double>, label int, n_links int")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in ego_join.near_duplicates(frame).collect()]
    assert len(got) == len(table)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    label = np.arange(len(vectors)) % 2
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    joined = components.union_find(*map(list, np.nonzero(linked)))
    for i, n, component, kept in got:
        if i < 900:
            assert n == linked[i].sum() and component == joined.get(i, i) and kept == (component == i)
        elif i == 905:
            assert n == 1 and component == 905
        elif i in (906, 907):
            assert n == 1 and component == 906
        else:
            assert n == 0 and component == i
    assert ego_join.near_duplicates(frame.limit(0)).count() == 0


def test_ego_join_skips_only_distant_blocks():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(700, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    order = np.lexsort(np.floor(points / 0.2).T[::-1])
    points = points[order]
    found = set()
    for i, j in ego_join.join_intervals(points, points, points, points, True, 0.2, 1 - 0.02):
        found |= set(zip(i.tolist(), j.tolist()))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(points @ points.T >= 1 - 0.02)) if i < j}
    assert found == want
