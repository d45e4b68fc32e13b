"""Corpus pipeline: quality rules, language ID, SimHash near-dedup, secret redaction and best-fit packing.

Each stage gets all documents that its predecessor kept; the stages before the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import language, packing, quality, secret_scan, simhash
from rasterloom.llm.common import id_fold
from rasterloom.llm.queries import END_ID, PIECES, SEQUENCE_TOKENS, WORD_TOKENIZER
from rasterloom.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_documents(docs)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least one half and that are likely enough in it."""
    model, floors = language.fit_with_floors(docs, id_fold(3) != 1, public_tokenizers.path(PIECES))
    return language.filter_documents(docs, model, floors=floors)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; of repeated rows with that doc_id one."""
    return simhash.keep_representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scan.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER), END_ID, SEQUENCE_TOKENS)


STAGES = [
    ("quality rules", keep_quality),
    ("language ID", keep_known_language),
    ("SimHash near-dedup", keep_first_of_group),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the language model, the redaction and the packing; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
