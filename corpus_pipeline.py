"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction, tokenization.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; each but the last returns the
columns of `documents`. In every stage repeated rows are judged alike, columns of other names pass through, whatever they
are called, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import bpe_stream, decontaminate, language_id, minhash, secret_scan
from blockloom.llm.common import materialize, small_batches, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null texts included, or whose text no learned language accounts for, go. Labels, ids and
    sources may be null: they are no inputs of the decision. Of equally likely mixtures either explains a text as well."""
    small_batches(spark)
    return language_id.accepted(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: five-word shingles, similarity 0.8. Of rows that repeat
    id and text one stays. Rows without an id, a text or a word are like no other and stay."""
    small_batches(spark)
    return minhash.deduplicated(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts hold none. A row without an id is told by its text."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; each secret in a text becomes its kind in brackets, and n_chars follows. Null texts stay null, with
    their n_chars; of overlapping secrets the one that begins first gives the kind."""
    small_batches(spark)
    return secret_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the digests of the ids and of the text decoded from them. Null and empty texts have no ids."""
    small_batches(spark)
    return bpe_stream.encode(docs, keep=("lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secret_scan", redact_secrets),
    ("bpe_encode", tokenize),
]

#: Language models, sketches and tokenizers are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
