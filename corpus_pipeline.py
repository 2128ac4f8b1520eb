"""A training-data pipeline over the documents table, each stage one operator of quillstream.llm.

Every stage works on all that its predecessor kept, written as Parquet and read again:
  quality   documents that the positive-unlabelled classifier rejects go
  dedup     of each group of near-duplicates the smallest doc_id stays
  pii       personal data are replaced by <EMAIL>, <IP>, <CARD> and <PHONE>
  mix       documents are sampled so that tokens meet the targets of source, language and topic
  pack      what stays is tokenized and packed into windows; the last stage returns the pieces
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import mixing, neardup, packing, pii, puclass
from quillstream.llm._support import stored, table, tidy
from quillstream.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more; without any positive label all stay."""
    tidy(spark)
    return puclass.accepted(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate group; rows without a doc_id stay."""
    tidy(spark)
    return neardup.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return mixing.sample(docs, kept=mixing.KEPT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return packing.pack(docs, tokenizer_file(), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("dedup", dedup),
    ("pii", personal_data),
    ("mix", mix),
    ("pack", pack),
]

#: Training a classifier has no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
