"""Chat messages with all their fields, types and depths, against brute force."""

import json
import random

import pytest

from rasterloom.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
PARAMETERS = {"type": "object", "required": ["n", "o"], "properties": {
    "n": {"type": "integer", "description": "how many"}, "s": {"type": "string", "enum": ["b", "a"]}, "f": {"type": ["number", "null"]},
    "o": {"type": "object", "required": ["deep"], "properties": {"deep": {"type": "array", "items": {"type": "object", "additionalProperties": False, "properties": {"k": {"type": "boolean"}}}}}},
    "b": {"type": "integer", "minimum": 3, "maximum": 5}, "e": {"exclusiveMinimum": 0, "exclusiveMaximum": 1, "minLength": 2, "maxLength": 3, "minItems": 1, "maxItems": 2}, "c": {"const": {"a": 1}}},
    "additionalProperties": {"type": "string"}}
TOOLS = {"tools": [{"name": "f", "description": "does it", "strict": True, "parameters": PARAMETERS}], "zone": {"b": 1, "a": [None, 2.5]}}
ARGUMENTS = [
    {"o": {"deep": []}, "n": 3}, {"o": {"deep": []}, "n": "3"}, {"o": {"deep": []}, "n": 3, "s": 5}, {"o": {"deep": []}, "n": 3, "s": "c"}, {"o": {"deep": []}, "n": 3, "s": "a", "f": None},
    {"o": {"deep": [{"k": True}, {"k": "x"}, {"z": 1}, 7]}, "n": 2.5}, {"o": {}, "n": 1}, {"n": True, "f": "1"}, "no object", json.dumps({"n": 1, "o": {"deep": [{"k": 0}]}}), {"o": [], "n": 3.0, "x": {"y": [1]}},
    {"o": {"deep": [], "more": 1}, "n": 1, "x": "y", "z": 1}, *({"o": {"deep": []}, "n": 1, "b": b} for b in (2, 3, 5, 6, 4.5)), *({"o": {"deep": []}, "n": 1, "e": e} for e in (0, 0.5, 1, "é", "éé", "ééé", "éééé", [], [1], [1, 2, 3], True)),
    *({"o": {"deep": []}, "n": 1, "c": c} for c in ({"a": 1}, {"a": 2}, 1)),
]


def faults(schema, value):
    """The rule written out over Python's values."""
    of = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}[type(value)]
    types = schema.get("type", [of])
    types = types if isinstance(types, list) else [types]
    if not any(t == of or (t == "integer" and of == "number" and value == int(value)) for t in types) or ("enum" in schema and value not in schema["enum"]) or ("const" in schema and value != schema["const"]):
        return 1
    size = value if of == "number" else len(value) if of in ("string", "array") else 0
    least, most = {"number": ("minimum", "maximum"), "string": ("minLength", "maxLength"), "array": ("minItems", "maxItems")}.get(of, ("", ""))
    if not schema.get(least, size) <= size <= schema.get(most, size) or (of == "number" and not schema.get("exclusiveMinimum", size - 1) < size < schema.get("exclusiveMaximum", size + 1)):
        return 1
    if of == "array":
        return sum(faults(schema.get("items", {}), v) for v in value)
    if of != "object":
        return 0
    own, others = schema.get("properties", {}), schema.get("additionalProperties", True)
    missing = sum(k not in value for k in schema.get("required", []))
    return missing + sum(faults(own[k], v) if k in own else others is False if isinstance(others, bool) else faults(others, v) for k, v in value.items())


def as_object(arguments):
    try:
        return arguments if isinstance(arguments, dict) else json.loads(arguments)
    except ValueError:
        return None


def expected(message, role, turn):
    """Canonical JSON by Python's writer."""
    calls = message.get("tool_calls")
    if calls:
        calls = [c | {"arguments": dump(as_object(c["arguments"]))} if isinstance(c["arguments"], str) and as_object(c["arguments"]) is not None else c for c in calls]
        message = message | {"tool_calls": calls}
    return dump(message | {"role": role, "turn": turn})


def dump(value):
    if isinstance(value, float) and value == int(value):
        value = int(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_every_field_is_written_and_checked(spark):
    table, want = [(1, 0, "system", json.dumps(TOOLS))], {}
    for i, arguments in enumerate(ARGUMENTS):
        message = {"z": {"b": "é", "a": [1, "1", True]}, "content": [{"type": "text", "text": "x"}], "tool_calls": [{"type": "function", "id": f"c{i}", "name": "f", "arguments": arguments, "depends_on": [f"c{i - 1}"]}]}
        table.append((1, i + 1, "assistant", json.dumps(message)))
        own = as_object(arguments)
        want[i + 1] = (2 * i, 1 if own is None else faults(PARAMETERS, own), expected(message, "assistant", i + 1).replace('"n":3.0', '"n":3'))
    got = {r["turn"]: r for r in chat_format.format_messages(spark.createDataFrame(table, SCHEMA)).collect()}
    for turn, (level, n, text) in want.items():
        assert (got[turn]["topo_level"], got[turn]["n_faults"], got[turn]["canonical"]) == (level, n, text)
    assert got[0]["canonical"] == expected(TOOLS, "system", 0) and len({n for _, n, _ in want.values()}) > 3


@pytest.mark.parametrize("tail", [" more", "] more", "} more", ",{}", ' {"b":1}', "]", "}"])
def test_text_behind_an_object_is_kept(spark, tail):
    text = json.dumps({"tool_call_id": "a"}) + tail
    got = chat_format.format_messages(spark.createDataFrame([(1, 0, "tool", text)], SCHEMA)).first()
    assert json.loads(got["canonical"])["content"] == text


def test_names_in_an_object_function(spark):
    """The form with ``function`` is linked, checked and written like the plain one; a name outside it goes first."""
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 3}}}
    given = [{"n": 3}, {"n": 1}, '{"z": 1, "n": 1}', "none", None]
    calls = [{"id": f"c{i}", "type": "function", "function": {"name": "f", "arguments": a}} for i, a in enumerate(given)]
    both = [{"id": "d", "name": "g", "function": {"name": "f", "arguments": {"n": 1}}}, {"id": "e", "function": "f"}]
    rows = [(1, 0, "system", json.dumps({"tools": [{"type": "function", "function": {"name": "f", "parameters": schema}}]})), (1, 1, "assistant", json.dumps({"tool_calls": calls})), (1, 2, "assistant", json.dumps({"tool_calls": both})), (1, 3, "tool", '{"tool_call_id":"c1"}')]
    got = {r["turn"]: r for r in chat_format.format_messages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["n_calls"], got[1]["n_linked"], got[1]["n_faults"], got[3]["topo_level"]) == (5, 1, 4, 1) and (got[2]["n_calls"], got[2]["n_faults"]) == (2, 0)
    calls[2]["function"]["arguments"] = '{"n":1,"z":1}'
    assert got[1]["canonical"] == dump({"tool_calls": calls, "role": "assistant", "turn": 1}) and got[2]["canonical"] == dump({"tool_calls": both, "role": "assistant", "turn": 2})


@pytest.mark.parametrize("number, plain", [("1e400", True), ("-1.5E+0400", True), ("9" * 400, True), ("9" * 250 + "e99", True), ("1e308", False), ("1e-400", False), ("0.5", False), ('"1e400 Infinity"', False), ('"Infinity"', False), ('"\\u00e999"', False)])
def test_numbers_beyond_doubles_leave_the_text_plain(spark, number, plain):
    text = f' \n{{"tool_call_id": "a", "x": {number}, "y": "-Infinity"}} '
    got = json.loads(chat_format.format_messages(spark.createDataFrame([(1, 0, "tool", text)], SCHEMA)).first()["canonical"])
    assert got == ({"content": text, "role": "tool", "turn": 0} if plain else {"tool_call_id": "a", "x": json.loads(number), "y": "-Infinity", "role": "tool", "turn": 0})


def longest(needs):
    """Levels by repeated passes over a dictionary; calls on or behind a cycle stay without."""
    level, before = {}, -1
    while len(level) != before:
        before = len(level)
        for call, own in needs.items():
            known = [level.get(n) for n in own if n in needs]
            if call not in level and None not in known:
                level[call] = max(known, default=-2) + 2
    return [level.get(c) for c in needs]


def test_deep_and_wide_calls_take_one_round(spark, monkeypatch):
    """Two thousand calls that each need the two before, in one round of levels."""
    rounds, write = [], chat_format.materialize
    monkeypatch.setattr(chat_format, "materialize", lambda frame, name: (rounds.append(name), write(frame, name))[1])
    ids = [f"d{i:04d}" for i in range(2000)]
    needs = {c: ids[max(0, i - 2) : i] for i, c in enumerate(ids)}
    got = {r["turn"]: r["topo_level"] for r in chat_format.format_messages(spark.createDataFrame(chain(ids, needs, 1), SCHEMA)).collect()}
    assert [got[t] for t in range(2000)] == [2 * t for t in range(2000)] and rounds.count("ready") == 1


def test_levels_over_many_blocks(spark, monkeypatch):
    """Random graphs, with cycles, several conversations and needs in any order, over blocks of four calls."""
    monkeypatch.setattr(chat_format, "BLOCK_BITS", 2)
    rng, rows, want = random.Random(5), [], {}
    for conv in range(4):
        ids = [f"k{i}" for i in range(24)]
        order = rng.sample(ids, len(ids)) if conv % 2 else ids
        needs = {c: [rng.choice(order[max(0, i - 6) : i]) for _ in range(rng.randint(0, 3))] if i else [] for i, c in enumerate(order)}
        if conv == 3:
            needs[order[12]].append(order[15])
            needs[order[15]] += [order[12], order[2]]
        needs = {c: needs[c] for c in ids}
        rows += chain(ids, needs, conv)
        want |= {(conv, t): level for t, level in enumerate(longest(needs))}
    got = {(r["conv_id"], r["turn"]): r["topo_level"] for r in chat_format.format_messages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and None in want.values() and max(v or 0 for v in want.values()) > 10


def chain(ids, needs, conv):
    return [(conv, t, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {}, "depends_on": needs[i]}]})) for t, i in enumerate(ids)]


def test_levels_have_no_last_round(spark):
    """A chain far over a thousand calls, one that forks and joins, and cycles with what hangs on them."""
    deep = [f"d{i}" for i in range(1500)]
    fork = {"a": [], "b": ["a"], "c": ["b"], "d": ["c", "a"], "e": ["d"], "f": ["e", "b", "missing"], "g": ["f"]}
    ring = {"p": ["r"], "q": ["p"], "r": ["q"], "s": ["r"], "t": ["s", "u"], "u": [], "v": ["t"]}
    rows = chain(deep, {i: deep[k - 1 : k] if k else [] for k, i in enumerate(deep)}, 1) + chain(list(fork), fork, 2) + chain(list(ring), ring, 3) + [(3, 50, "tool", '{"tool_call_id":"q"}'), (3, 51, "user", "hi")]
    got = {(r["conv_id"], r["turn"]): r["topo_level"] for r in chat_format.format_messages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[1, t] for t in range(1500)] == [2 * t for t in range(1500)]
    assert [got[2, t] for t in range(7)] == [0, 2, 4, 6, 8, 10, 12]
    assert [got[3, t] for t in range(7)] == [None, None, None, None, None, 0, None] and got[3, 50] is None and got[3, 51] == 0
