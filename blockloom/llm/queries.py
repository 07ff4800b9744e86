"""The registered queries of this folder and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import bpe_stream, chat, decontaminate, language_id, license_scan, minhash, secret_scan, sharding, token_counts, vector_dedup
from blockloom.llm.common import small_batches, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.render(chat.fold(chat.with_probe(table(spark, sf_dir, "conversations")))))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode(table(spark, sf_dir, "documents"), ids=False)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _in_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query is an application: it sets how much its executors' Python functions get at once."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_chat_format": op4_chat_format,
    "op5_secret_scan": op5_secret_scan,
    "op6_bpe_roundtrip": op6_bpe_roundtrip,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_shard_ring": op8_shard_ring,
    "op9_license_scan": op9_license_scan,
    "op10_decontaminate": op10_decontaminate,
}
QUERIES = {name: _in_small_batches(query) for name, query in QUERIES.items()}

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": minhash.oracle(4, 80),
    "op4_chat_format": chat.ORACLE,
    "op7_embedding_dedup": vector_dedup.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}
