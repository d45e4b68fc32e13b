"""Importance resampling towards a target by a dictionary of distinct features.

A text's features are its runs of one to ``longest`` consecutive words.  Texts
become counts of distinct features; the counts are added up over all documents,
so each distinct feature is hashed to its bucket once.  A bucket's gain compares
its share in the target with its share in the documents; gains go back to the
features of the dictionary and by a join to the documents' feature counts.
Documents get their weight plus noise from a hash of their id, and the highest
scores are drawn.

Features that hold a large share of all feature counts are at most
``HEAVY_FEATURES``; they are joined by broadcast, the others by their hash, so no
word that all documents have meets in one task.  The order of the draw comes from
a range partitioning with the number of rows before each partition.

Defined cases: a null text has no words, a document without features weighs 0; a
null doc_id counts as an empty text in the hash and comes last among equal
scores; repeated rows are documents of their own; an empty target has only
zeros; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from rasterloom.llm.common import batch_slices, map_arrow
from rasterloom.session import materialize

LONGEST_RUN, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Features with at least this share of all (document, feature) rows are broadcast; there are no more than its inverse.
HEAVY_FEATURES = 50_000
#: Words of lower-cased UTF-8: digits, a to z and everything that is not ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_ROW_BITS = 33


def features_of(raw: bytes, longest: int = LONGEST_RUN) -> tuple[int, Counter]:
    """Number of words, and all runs of one to ``longest`` words with how often they occur."""
    words = _WORD.findall(raw.lower())
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return len(words), found


def feature_counts(texts: DataFrame, longest: int = LONGEST_RUN) -> DataFrame:
    """For each row its other columns, n_words, n_features and features (feature, n), written to the shared folder with a key ``k``."""
    kept = [f for f in texts.schema.fields if f.name != "text"]
    feature = ArrayType(StructType([StructField("feature", BinaryType()), StructField("n", IntegerType())]), False)
    schema = StructType([*kept, StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("features", feature)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for part in batch_slices(batches):
            words, sums, sizes, names, counts = [], [], [], [], []
            for raw in part["text"].cast(pa.binary()).to_pylist():
                n, found = features_of(raw or b"", longest)
                words.append(n)
                sums.append(sum(found.values()))
                sizes.append(len(found))
                names.extend(found)
                counts.extend(found.values())
            inner = arrow.field("features").type.value_type
            rows = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int32())], fields=list(inner))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), rows).cast(arrow.field("features").type)
            yield pa.RecordBatch.from_arrays([*(part[f.name] for f in kept), pa.array(words, pa.int64()), pa.array(sums, pa.int64()), lists], schema=arrow)

    return materialize(map_arrow(texts, run, schema).withColumn("k", F.monotonically_increasing_id()), "feature-counts")


def dictionary(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Every distinct feature once: bucket, how often it occurs (total) and in how many rows (rows)."""
    added = counted.select(F.inline("features")).groupBy("feature").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    return added.withColumn("bucket", (F.crc32("feature") % buckets).cast("int"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of the buckets of dictionary ``own``; no more rows than buckets."""
    s, t = (d.groupBy("bucket").agg(F.sum("total").alias(c)) for d, c in ((own, "s"), (target, "t")))
    all_s, all_t = (float(d.agg(F.sum("total").alias("n")).first()["n"] or 0) for d in (own, target))
    up = (F.coalesce("t", F.lit(0)).cast("double") + 1.0) * F.lit(all_s + buckets)
    down = (F.col("s").cast("double") + 1.0) * F.lit(all_t + buckets)
    return s.join(t, "bucket", "left").select("bucket", F.floor(1000.0 * F.log(up / down)).cast("long").alias("gain"))


def _floored(total: Column, n: Column) -> Column:
    """The floor of total / n in whole numbers."""
    whole = F.when(n != 0, n)
    return F.coalesce(F.call_function("div", total - F.pmod(total, whole), whole), F.lit(0).cast("long"))


def weigh(counted: DataFrame, words: DataFrame) -> DataFrame:
    """k, doc_id, n_words, n_features and weight of every counted row; ``words``: feature, rows and gain."""
    everything = words.agg(F.sum("rows").alias("n")).first()["n"] or 0
    often = words.where(F.col("rows") * HEAVY_FEATURES >= everything).select("feature", "gain")
    seldom = words.where(F.col("rows") * HEAVY_FEATURES < everything).select("feature", "gain")
    single = counted.select("k", F.inline("features"))
    added = lambda joined: joined.groupBy("k").agg(F.sum(F.col("gain") * F.col("n")).alias("gained"))
    near = added(single.join(F.broadcast(often), "feature"))
    far = added(single.join(F.broadcast(often), "feature", "left_anti").join(seldom, "feature"))
    own = counted.select("k", F.col("doc_id"), "n_words", "n_features", F.lit(0).cast("long").alias("gained"))
    none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("doc_id", "n_words", "n_features")]
    rows = own.unionByName(near.unionByName(far).select("k", *none, "gained")).groupBy("k").agg(*[F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")], F.sum("gained").alias("gained"))
    return rows.select("k", "doc_id", "n_words", "n_features", _floored(F.col("gained"), F.col("n_features")).alias("weight"))


def noise(seed: int = SEED, column: str = "doc_id") -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score_documents(docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    counted = feature_counts(docs.select("doc_id", "text"), longest)
    own = materialize(dictionary(counted, buckets), "feature-dictionary")
    wanted = dictionary(feature_counts(target.select("text"), longest), buckets)
    words = own.join(F.broadcast(gains(own, wanted, buckets)), "bucket")
    scored = materialize(weigh(counted, words).withColumn("score", F.col("weight") + noise(seed)).withColumn("open", F.col("n_words") >= least_words), "scored")
    return ranked(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")


def ranked(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Add ``rank`` to the given share of the open rows, by falling score, then by doc_id; no window holds more than one row for each partition."""
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("k").asc()]
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(scored.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", _ROW_BITS)
    sizes = sorted((r["part"], r["n"], r["open"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("open")).collect())
    drawn, before, starts = percent * sum(o for *_, o in sizes) // 100, 0, []
    for p, rows, _ in sizes:
        starts.append((p, before))
        before += rows
    # one row for each partition of the range partitioning
    offsets = placed.sparkSession.createDataFrame(starts, "part long, before long")
    place = F.col("before") + F.col("at").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(F.col("open") & (place <= drawn), place)).drop("part", "before", "at")


def draw(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, with all their columns; rows without an id are not drawn."""
    return docs.join(score_documents(docs, target, **parameters).where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi")


ORACLE_SQL = r"""
WITH crc_table AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v FROM range(256) r(b))),
texts AS (SELECT 'd' AS side, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
split AS MATERIALIZED (SELECT side, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
words AS MATERIALIZED (SELECT side, k, unnest(ws) AS w FROM split),
bytes AS (SELECT w, list_transform(range(0, length(hex(w)) // 2), lambda i: CAST('0x' || substr(hex(w), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM words)),
dictionary AS MATERIALIZED (SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN dictionary USING (w) GROUP BY bucket),
gains AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts),
weights AS (SELECT k, CAST(sum(gain) AS BIGINT) AS total FROM words JOIN dictionary USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY k),
scored AS (SELECT k, doc_id, CAST(len(ws) AS BIGINT) AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) END AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h FROM split LEFT JOIN weights USING (k) WHERE side = 'd'),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score, n_features >= 20 AS open FROM scored),
placed AS (SELECT *, row_number() OVER (ORDER BY open DESC, score DESC, doc_id NULLS LAST, k) AS place, count(*) FILTER (open) OVER () AS n FROM noisy)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN open AND place <= 10 * n // 100 THEN place END AS BIGINT) AS rank FROM placed
"""
