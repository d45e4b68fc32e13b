"""Chat formatting against its SQL form, on a generated table with calls, results, cycles and a hot conversation."""

import json
import random

import duckdb

from rasterloom.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
PARAMETERS = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "s": {"type": ["string", "null"], "enum": ["a", "b", None]}, "o": {"type": "object", "required": ["k"], "properties": {"k": {"type": "array", "maxItems": 1, "items": {"type": "boolean"}}}, "additionalProperties": False}, "m": {"minimum": 3, "exclusiveMaximum": 5.5, "minLength": 2, "maxLength": 3}, "c": {"const": "k"}, "w": {"additionalProperties": {"type": "string"}}}}
VALUES = {"n": [1, "1", 2.5, None, 7], "s": ["a", "c", None, 3], "o": [{"k": [True, False]}, {"k": [True, 1]}, {}, {"k": [], "z": 1}, []], "x": [{"b": 1, "a": [2, "é\n"]}], "m": [2, 3, 5.5, 5, "é", "éé", "abcd", [1]], "c": ["k", 1, None], "w": [{"p": "q"}, {"p": 1, "q": "r"}, {}, 3]}


def generated(seed=11):
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        turns = 150 if conv == 0 else 12
        rows.append((conv, 0, "system", json.dumps({"tools": [{"name": "f", "description": "does", "parameters": PARAMETERS}, {"name": "g"}, {"type": "function", "function": {"name": "h", "parameters": PARAMETERS | {"additionalProperties": False}}}, {"name": "f", "parameters": {"type": "string"}}]})))
        made = []
        for turn in range(1, turns):
            kind = rng.random()
            if kind < 0.45:
                calls = []
                for _ in range(rng.randint(0, 3)):
                    call = f"c{len(made)}"
                    needs = [f"c{rng.randint(0, len(made) + (3 if conv % 3 == 2 else -1))}" for _ in range(rng.choice([0, 0, 1, 1, 2]))] if made else []
                    arguments = {k: rng.choice(v) for k, v in VALUES.items() if rng.random() < 0.6}
                    calls.append({"name": rng.choice(["f", "f", "g", "h"]), "id": call, "arguments": rng.choice([arguments, arguments, json.dumps(arguments), "none", None]), "depends_on": needs})
                    made.append(call)
                    if rng.random() < 0.3:
                        calls[-1] = {"id": call, "type": "function", "function": {"name": calls[-1]["name"], "arguments": calls[-1]["arguments"]}, "depends_on": needs}
                if made and rng.random() < 0.1:
                    calls.append({"name": "f", "id": rng.choice(made), "arguments": {"n": 1}})
                rows.append((conv, turn, "assistant", json.dumps({"content": rng.choice(["ok", None, [1, {"t": "x"}]]), "tool_calls": calls, "a": 1.0})))
            elif kind < 0.7 and made:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*made, "nobody"]), "content": rng.choice(["done", 5])})))
            else:
                rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["plain words", "{not json", ' \n{"tool_call_id":"c1"}', '{"tool_call_id":"c1","n":-1e400}', '{"tool_call_id":"c1","n":1.5e0,"s":"Infinity 1e999"}', '{"other":1}', '{"tool_call_id":"c0","tool_call_id":"c1"}', 'say "é"\n', None, ""])))
    ring = {"p": ["r"], "q": ["p"], "r": ["q"], "s": ["r"], "t": ["u", "s"], "u": [], "v": ["u"]}
    rows += [(50, t, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "f", "depends_on": needs}]})) for t, (i, needs) in enumerate(ring.items())]
    rows += [(50, 20 + t, "tool", json.dumps({"tool_call_id": i})) for t, i in enumerate("pqv")]
    return [*rows, (None, 1, "tool", '{"tool_call_id":"c0"}'), (3, None, None, "no turn"), (3, 5, "user", "again"), (3, 5, "user", "again")]


def test_sql_form_agrees(spark):
    rows = generated()
    frame = spark.createDataFrame(rows, SCHEMA)
    names = ["conv_id", "turn", "role", "topo_level", "n_calls", "n_linked", "n_faults", "canonical"]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r[n] for n in names) for r in chat_format.format_messages(frame).collect()), key=key)
    con = duckdb.connect()
    conversations = frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    con.execute("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM conversations")
    cursor = con.execute(chat_format.ORACLE_SQL)
    order = [d[0] for d in cursor.description]
    want = sorted((tuple(dict(zip(order, r))[n] for n in names) for r in cursor.fetchall()), key=key)
    assert len(got) == len(rows)
    assert [(w, g) for w, g in zip(want, got, strict=True) if w != g][:3] == []
    assert sum(r[5] for r in got) > 20 and sum(r[6] for r in got) > 20 and len({r[3] for r in got}) > 5 and any(r[3] is None for r in got)
