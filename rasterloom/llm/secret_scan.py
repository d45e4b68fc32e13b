"""Secret scans by assignment-aware lexing.

Base spans come from three fixed patterns.  Beyond them, assignments are read
from source and configuration syntax (``name = "literal"``, ``name: literal``,
``"name": "literal"``, ``name := literal``, ``name => literal``, joined literals
``"a" + "b"``), constants are propagated to the names they are assigned to, and
each literal is scored by the most sensitive name it reaches and by how much it
looks like a key.  A literal that scores enough and lies in no base span gives a
span of kind ``named``.

Defined cases: a null text counts as empty; texts without assignments have no
spans beyond the base; positions are code points, ends exclusive; repeated rows
give repeated results; redaction keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from rasterloom.llm.common import map_arrow, release_held, text_slices

#: Kinds in the order of ties, base patterns and least lengths.
KINDS = ("assign", "access", "hex", "named")
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(pattern: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", pattern)


ASSIGN = re.compile("(" + "|".join(map(_either_case, _KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Sensitivity of the parts of a name.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3,
    "cred": 2, "auth": 2, "bearer": 2, "private": 1, "access": 1, "signing": 1, "encryption": 1, "api": 1, "key": 1, "salt": 1,
}
_HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "salt")
PLACEHOLDERS = {"changeme", "example", "password", "secret", "token", "none", "null", "true", "false", "undefined", "placeholder", "redacted", "your_password", "your_token"}
LEAST_SCORE = 5.0
_OPERATOR = re.compile(r"[=:]")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
_BARE = re.compile(r"[^\s\"'`,;{}()\[\]<>]+")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int


class Part(NamedTuple):
    """A piece of an assigned value: a literal, or a bare word that may name a constant."""

    start: int
    end: int
    quoted: bool


class Assignment(NamedTuple):
    name: str
    parts: tuple[Part, ...]


def base_spans(text: str) -> list[Span]:
    lowered = text.lower()
    found = []
    if any(stem in lowered for stem in _STEMS):
        found += [Span("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [Span("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return found


def _name_before(text: str, at: int) -> str:
    end = at
    while end > 0 and text[end - 1] in " \t":
        end -= 1
    while end > 0 and text[end - 1] in "\"'])":
        end -= 1
    start = end
    while start > 0 and text[start - 1] in _NAME_CHARS:
        start -= 1
    return text[start:end].strip(".-")


def _value_at(text: str, at: int) -> tuple[tuple[Part, ...], int]:
    """The joined parts of the value at a position, and where the first of them ends."""
    parts: list[Part] = []
    while True:
        quoted = _QUOTED.match(text, at)
        bare = None if quoted else _BARE.match(text, at)
        if quoted:
            parts.append(Part(*quoted.span(quoted.lastindex), True))
            at = quoted.end()
        elif bare and (word := bare[0].rstrip(".:")):
            parts.append(Part(at, at + len(word), False))
            at += len(word)
        else:
            break
        plus = _PLUS.match(text, at)
        if not plus:
            break
        at = plus.end()
    return tuple(parts), at


def assignments(text: str) -> list[Assignment]:
    out, done = [], 0
    for m in _OPERATOR.finditer(text):
        at = m.start()
        if at < done:
            continue
        after = at + 1
        if text.startswith(("==", "::", "://"), at) or (at and text[at - 1] in "=!<>:" and text[at - 1 : at + 1] != ":="):
            done = after + 1
            continue
        name = _name_before(text, at - 1 if text[at - 1 : at + 1] == ":=" else at)
        if not name or not (name[0].isalpha() or name[0] == "_"):
            continue
        if text.startswith(("=", ">"), after):
            after += 1
        while after < len(text) and text[after] in " \t":
            after += 1
        parts, end = _value_at(text, after)
        if parts:
            out.append(Assignment(name, parts))
            # a bare word may itself be a name with a value
            done = end if parts[0].quoted else after
    return out


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    return float(min(4, sum(SENSITIVE.get(p, 0) for p in parts)))


def likeness(literal: str) -> float:
    """How much a literal looks like a key: length, spread of characters and mixture of kinds."""
    if len(literal) < 6 or literal.lower() in PLACEHOLDERS or any(c.isspace() for c in literal) or literal.startswith(("${", "<", "%", "{{", "http:", "https:", "/")):
        return -9.0
    counts = Counter(literal)
    spread = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum(any(map(f, literal)) for f in (str.isdigit, str.islower, str.isupper)) + any(not c.isalnum() for c in literal)
    return (len(literal) >= 8) + (len(literal) >= 16) + (spread >= 2.8) + (kinds >= 2) * 1.0 - (kinds == 1 and len(literal) < 20) * 1.5


def named_spans(text: str) -> list[Span]:
    lowered = text.lower()
    if not any(hint in lowered for hint in _HINTS) or ("=" not in text and ":" not in text):
        return []
    found = assignments(text)
    last = {name: i for i, (name, _) in enumerate(found)}
    before: dict[str, int] = {}
    literals: list[list[Part]] = []
    uses: list[list[int]] = []
    for i, (name, parts) in enumerate(found):
        words = [None if p.quoted else text[p.start : p.end] for p in parts]
        # a name stands for its last value before the place, or for its last one at all where none comes before
        uses.append([before.get(w, last[w]) for w in words if w in last])
        literals.append([p for p, w in zip(parts, words) if w not in before])
        before[name] = i
    reach: dict[Part, float] = {}
    scores, seen = [sensitivity(name) for name, _ in found], [False] * len(found)
    # the most sensitive first: what an assignment is reached by first is the most sensitive name that it reaches
    for root in sorted(range(len(found)), key=lambda i: -scores[i]):
        waiting = [root]
        while waiting:
            i = waiting.pop()
            if seen[i]:
                continue
            seen[i] = True
            for value in literals[i]:
                reach[value] = max(reach.get(value, 0.0), scores[root])
            waiting.extend(uses[i])
    return [Span("named", v.start, v.end, v.start) for v, score in reach.items() if score >= 2 and score + likeness(text[v.start : v.end]) >= LEAST_SCORE]


def all_spans(text: str | None) -> list[Span]:
    """Base spans and the method's, by start, then kind."""
    text = text or ""
    base = base_spans(text)
    ends = [0, *accumulate((s.end for s in sorted(base, key=lambda s: s.start)), max)]
    starts = sorted(s.start for s in base)
    extra = [s for s in named_spans(text) if ends[bisect_right(starts, s.start)] < s.end]
    return sorted([*base, *extra], key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with the values of all spans replaced; names stay."""
    spans = all_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for start, end in sorted((s.value_start, s.end) for s in spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def map_spans(docs: DataFrame, finish: Callable[[list[Span]], tuple], fields: list[StructField]) -> DataFrame:
    """doc_id with what ``finish(spans)`` makes of each text's spans."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        release_held()
        arrow = to_arrow_schema(schema)
        for part, texts in text_slices(batches):
            columns = zip(*[finish(all_spans(t)) for t in texts], strict=True)
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(arrow.field(0).type), *(pa.array(list(c), arrow.field(i + 1).type) for i, c in enumerate(columns))], schema=arrow)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every document."""
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    return map_spans(docs, lambda spans: ([{"kind": s.kind, "start": s.start, "end": s.end} for s in spans],), [StructField("spans", ArrayType(span))])


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns with secrets replaced in ``text`` (and ``n_chars`` counted anew where it is there)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        for part, texts in text_slices(batches):
            clean = [redact(t) for t in texts]
            columns = [part.column(i) for i in range(part.num_columns)]
            at = names.index("text")
            columns[at] = pa.array(clean, columns[at].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                old = columns[i].to_pylist()
                columns[i] = pa.array([len(c) if c is not None and c != t else n for c, t, n in zip(clean, texts, old, strict=True)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return map_arrow(docs, run, docs.schema)
