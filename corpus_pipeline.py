"""From raw documents to token ids: toxicity, near-duplicates, repeated passages, mix, tokens.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next stage's documents.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm import bpe, mixing, queries, simhash, substring, toxicity
from tarnwell.llm.common import saved, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; null texts are kept."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), queries.toxic_chain(), rows=12_000)
    return toxicity.kept(docs, chain)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return simhash.similar_dedup(docs, shingle=5)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id has."""
    return substring.removed(docs, window=13)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mixed(docs, max_epochs=3, seed=42, cycle=3)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each row."""
    return bpe.round_trip(docs, public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN, spaced=True)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("repeated_passages", without_repeats),
    ("mixing", to_target_weights),
    ("byte_bpe", to_tokens),
]

#: A fitted classifier decides the first stage, which SQL cannot express; the tests
#: hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
