"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, mixing, quality, simhash, substring, topk, toxicity, urls, warc
from .common import table

#: The vocabulary file that the registered queries use.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), max_epochs=3, seed=42, cycle=3)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), least_bytes=0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, spaced=True)


def held_out() -> Column:
    """Rows whose labels no model sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()), rows=10_000)
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted")
    )


def toxic_chain() -> dict[str, Column]:
    """The categories that the labels have, in the order of the chain; the last one decides."""
    return {"disruptive": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()), toxic_chain(), rows=12_000)
    return toxicity.score(docs.select("doc_id", "text"), chain).select(
        "doc_id",
        held_out().alias("held_out"),
        *[F.col("_p")[k].alias(f"p_{c}") for k, c in enumerate(chain.categories)],
        F.col("_rejected").cast("int").alias("toxic"),
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup(docs, window=13).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


#: Verdict, host and path of the fixed rules.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES, bad)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def queries() -> dict:
    return {
        "op5_urls": op5_urls,
        "op7_topk": op7_topk,
        "op8_ann": op8_ann,
        "op2_substring": op2_substring,
        "op1_simhash": op1_simhash,
        "op4_quality": op4_quality,
        "op6_toxicity": op6_toxicity,
        "op10_byte_bpe": op10_byte_bpe,
        "op9_warc": op9_warc,
        "op3_mixing": op3_mixing,
    }


TOPK_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_topk": TOPK_SQL,
        "op2_substring": substring.SUBSTRING_SQL,
        "op9_warc": warc.WARC_SQL,
        "op3_mixing": mixing.MIX_SQL.format(docs="documents"),
    }
