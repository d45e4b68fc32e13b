"""Quality rules as a short-circuit cascade.

Each rule's cost and rejections are measured on a bounded sample, in the tasks
that hold its rows.  The order is greedy: the next rule is the one with most
rejections per second among the sample's rows that no earlier rule rejects.  A
document leaves at the first rule that rejects it.  The order decides only how
much work is done: a document is kept if no rule rejects it.

Words are ``[^\\x20\\x09-\\x0D]+``; measures of a text are computed when a rule first
asks for them.

Defined cases: a null or empty text has no words and fails ``few_words``; equal
rows get equal verdicts; filters keep all columns, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from rasterloom.llm.common import map_arrow, release_held, text_slices

WINDOW_WORDS = 5
SAMPLE_ROWS = 1000
#: Fixed values.
SYMBOLS = b"#*$%&|<>"
WORD_BREAKS = b" \t\n\r\x0b\x0c"


class TextMeasures:
    """Measures of one text, each computed once when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.raw.count, WORD_BREAKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.raw.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line and not line.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of five words that the text has twice or more."""
        return repeated_words(self.words)

    @cached_property
    def letter_share(self) -> float:
        return sum(map(str.isalpha, self.text)) / max(1, self.word_chars)


def repeated_words(words: list[bytes], window: int = WINDOW_WORDS) -> int:
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == len(words):
        return 0
    base, key = len(number), ids[:n].copy()
    size = base
    for k in range(1, window):
        if size * base >= 1 << 63:
            uniques, key = np.unique(key, return_inverse=True)
            key, size = key.astype(np.uint64), len(uniques)
        key = key * np.uint64(base) + ids[k : k + n]
        size *= base
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextMeasures], bool]


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m: m.n_words < 10),
        Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
    ]


def further_rules() -> list[Rule]:
    """Wide limits: ordinary prose, lists and tables stay well inside them."""
    return [
        Rule("symbols", lambda m: m.n_symbols > m.n_words),
        Rule("duplicate_lines", lambda m: len(m.lines) >= 4 and 2 * m.n_dup_lines > len(m.lines)),
        Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 40 * m.n_words),
        Rule("few_letters", lambda m: m.letter_share < 0.4),
    ]


def order_rules(names: list[str], trials: list[tuple[dict[str, bool], dict[str, float]]]) -> list[str]:
    """Rules by rejections per second among the rows that no rule before them rejects; ``trials``: verdicts and seconds of every rule on each row."""
    left, out, rest = list(trials), [], list(names)
    while rest:
        rate = lambda n: (sum(v[n] for v, _ in left) / max(1e-9, sum(t[n] for _, t in left)), -sum(t[n] for _, t in left))  # noqa: B023, E731
        out.append(max(rest, key=rate))
        rest.remove(out[-1])
        left = [row for row in left if not row[0][out[-1]]]
    return out


def measure_rules(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[dict[str, bool], dict[str, float]]]:
    """Verdict and seconds of every rule on about ``rows`` texts from all partitions, each rule with nothing computed before; the texts stay in their tasks."""
    count = docs.count()
    if not count:
        return []
    share = min(1.0, rows / count)
    picked = docs.select("text") if share == 1.0 else docs.select("text").sample(False, share, seed)
    names = [r.name for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _by_name(names)
        for _, texts in text_slices(batches):
            verdicts, seconds = [], []
            for text in texts:
                row, spent = [], []
                for rule in own:
                    measures = TextMeasures(text)
                    began = time.perf_counter()
                    row.append(rule.rejects(measures))
                    spent.append(time.perf_counter() - began)
                verdicts.append(row)
                seconds.append(spent)
            yield pa.RecordBatch.from_arrays([pa.array(verdicts, pa.list_(pa.bool_())), pa.array(seconds, pa.list_(pa.float64()))], names=["verdicts", "seconds"])

    return [(dict(zip(names, r["verdicts"])), dict(zip(names, r["seconds"]))) for r in map_arrow(picked, run, "verdicts array<boolean>, seconds array<double>").collect()]


def cascade(rules: list[Rule], measures: TextMeasures) -> str | None:
    """The name of the first rule that rejects, or None."""
    return next((r.name for r in rules if r.rejects(measures)), None)


def _by_name(names: list[str]) -> list[Rule]:
    known = {r.name: r for r in [*base_rules(), *further_rules()]}
    return [known[n] for n in names]


def filter_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    rules = [*base_rules(), *further_rules()]
    names = order_rules([r.name for r in rules], measure_rules(docs, rules, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        rules = _by_name(names)
        for part, texts in text_slices(batches):
            yield part.filter(pa.array([cascade(rules, TextMeasures(t)) is None for t in texts], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: the base measures, ``base_failed``, ``kept`` and ``rejected_by``."""
    rules = [*base_rules(), *further_rules()]
    trials = measure_rules(docs, rules, sample_rows)
    base = order_rules([r.name for r in base_rules()], trials)
    # the further rules see what the base rules leave
    names = order_rules([r.name for r in further_rules()], [row for row in trials if not any(row[0][n] for n in base)])
    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(m, LongType()) for m in MEASURES),
        StructField("base_failed", BooleanType()), StructField("kept", BooleanType()), StructField("rejected_by", StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        release_held()
        arrow, first, then = to_arrow_schema(schema), _by_name(base), _by_name(names)
        for part, texts in text_slices(batches):
            columns: list[list] = [[] for _ in schema.fields[1:]]
            for text in texts:
                measures = TextMeasures(text)
                failed = cascade(first, measures)
                why = failed or cascade(then, measures)
                for column, value in zip(columns, [*(getattr(measures, m) for m in MEASURES), failed is not None, why is None, why], strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(arrow.field(0).type), *(pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(columns))], schema=arrow)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT k, i, array_to_string(ws[i:i+4], ' ') AS five FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 6)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS n FROM windows) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM twice CROSS JOIN range(5) r(j) GROUP BY k),
m AS (SELECT w.k, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, length(regexp_replace(t, '[^\pL]', '', 'g')) AS letters FROM w LEFT JOIN covered USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR word_chars < 2 * n_words OR word_chars > 40 * n_words OR letters::DOUBLE / greatest(1, word_chars) < 0.4) AS kept
FROM m
"""
