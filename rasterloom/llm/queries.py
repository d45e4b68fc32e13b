"""The contract's queries: each applies its operator to whole tables and derives the asked columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from rasterloom.llm import byte_bpe, chat_format, ego_join, importance, language, license_scan, packing, quality, secret_scan, simhash, token_files, toxicity, vector_codes
from rasterloom.llm.common import id_fold
from rasterloom.session import scratch_path

END_ID = 1
SEQUENCE_TOKENS = 4096
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_held_out(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """Add held_out right behind doc_id; rows without an id are not held out."""
    held_out = F.coalesce(id_fold(modulus) == remainder, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, *[c for c in scored.columns if c != "doc_id"])


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, id_fold(3) != 1, public_tokenizers.path(PIECES))
    return with_held_out(language.predict(docs, model), 3, 1)


def _bpe_digest(codec: byte_bpe.ByteBpe, ids: list[int]) -> tuple[int, str, str]:
    joined = ",".join(map(codec.decimal.__getitem__, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return byte_bpe.map_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, _bpe_digest, fields)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID, SEQUENCE_TOKENS)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _joined_spans(spans: list[secret_scan.Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _span_digest(spans: list[secret_scan.Span]) -> tuple[int, int, int, str, str]:
    base = [s for s in spans if s.kind != "named"]
    counts = [sum(s.kind == kind for s in base) for kind in ("assign", "access", "hex")]
    return *counts, hashlib.sha256(_joined_spans(base).encode()).hexdigest(), _joined_spans(spans)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [*(StructField(c, LongType()) for c in ("n_assign", "n_access", "n_hex")), StructField("base_sha256", StringType()), StructField("spans", StringType())]
    return secret_scan.map_spans(table(spark, sf_dir, "documents"), _span_digest, fields)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_fold(5) != 0)
    return with_held_out(toxicity.score(docs, model), 5, 0).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_messages(table(spark, sf_dir, "conversations"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_TOKENIZER), END_ID)
    read = token_files.read_token_files(spark, path, token_files.crc_of_ids, token_files.CRC_FIELDS)
    return token_files.with_starts(read, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule rejects first depends on the measured order; the verdict does not
    return quality.measure_documents(table(spark, sf_dir, "documents")).drop("rejected_by")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_language, op2_byte_bpe, op3_best_fit_packing, op4_simhash, op5_secret_scan, op6_toxicity, op7_chat_format, op8_embedding_dedup, op9_token_files, op10_quality, op11_vector_codes, op12_importance, op13_license_scan)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_chat_format": chat_format.ORACLE_SQL, "op8_embedding_dedup": ego_join.ORACLE_SQL, "op10_quality": quality.ORACLE_SQL,
        "op11_vector_codes": vector_codes.ORACLE_SQL, "op12_importance": importance.ORACLE_SQL, "op13_license_scan": license_scan.ORACLE_SQL,
    }
