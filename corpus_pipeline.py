"""A training-corpus pipeline over ``documents``: classify, deduplicate, decontaminate, mask secrets, encode.

Each stage takes all rows that the one before kept. ``run`` writes every stage's result as Parquet in the shared
folder and reads it again, so a stage's several passes don't repeat the stages before it.

Defined results of every stage: null or empty texts are classified by their metadata, are near duplicates of each other, leak
nothing, hold no secrets and encode to no tokens; of repeated rows one stays after near duplicates; rows with a null id stay
only where their whole group of near duplicates has none; an empty table gives an empty table; extra columns pass through all
stages but the last, whatever their names. The last returns ``doc_id, n_tokens, ids, decodes`` only: its text is its ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm import byte_bpe, cotrain, decontaminate, secrets, simhash
from billweave.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return cotrain.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that of the smallest id."""
    return simhash.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are masked; ``n_chars`` follows the text."""
    masked = docs.withColumn("text", secrets.redacted(F.col("text"), secrets.dictionary(docs)))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them."""
    return byte_bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scan", secret_masking),
    ("byte-level BPE", encoding),
]
#: The stages train a classifier and run a tokenizer, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
