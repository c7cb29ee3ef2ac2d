"""A training corpus from raw documents: rated, deduplicated, mixed and encoded.

Every stage is a function of (spark, docs, folder of the given tables) and works on all
rows the one before it kept; between stages the rows are written as Parquet.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from effectframe.llm import mixing, prefix_bpe, quality, simhash, suffix_dedup
from effectframe.llm.queries import quality_model
from effectframe.session import ensure_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is at least a half."""
    return quality.good_documents(docs, quality_model(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings which documents with smaller ids have as well."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return prefix_bpe.encode_documents(docs, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Fits and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; runs jobs, as stages meet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
