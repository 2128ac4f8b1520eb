"""The subpackage's queries, by the names under which they are registered, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import chat, html_text, mixing, packing, pii, puclass, quality, simhash, tokenfile, topk
from quillstream.llm._support import table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file; QUILLSTREAM_TOKENIZERS names another folder."""
    folder = os.environ.get("QUILLSTREAM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), kept=mixing.KEPT)


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=1)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.render(table(spark, sf_dir, "pages"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.digest(chat.chat(chat.as_chains(rows)))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return puclass.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_topk": op2_topk,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_token_file": op5_token_file,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_html_text": op8_html_text,
    "op9_chat": op9_chat,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {"op2_topk": topk.SQL, "op9_chat": chat.SQL}
