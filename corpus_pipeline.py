"""A training corpus from ``documents``: five stages, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm import bpe, decontaminate, quality, secret_scan, simhash
from coffer.llm.common import cut


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model of the trusted ones does not reject."""
    return quality.accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group that fingerprints of 3-word shingles link at 2 bits."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; the count of characters follows the text."""
    masked = secret_scan.mask_secrets(docs)
    n_chars = F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("bigint"))
    return masked.withColumn("n_chars", n_chars)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    same = bpe.decode("tokens", ranks) == F.coalesce("text", F.lit("")).cast("binary")
    return tokens.select("doc_id", "lang", "source", "tokens", F.size("tokens").cast("bigint").alias("n_tokens"), same.alias("decodes"))


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", encoded),
]

#: SQL has neither the language model, the fingerprints' hash, the network nor the merges
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
