"""The queries of this subpackage: each applies one operator to its whole table.

Tokenizer files come by a parameter; the defaults are the public files that are
installed with ``public_tokenizers``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, embeddings, langid, leaks, licenses, packing, pii, quality, simhash
from .common import table
from .oracles import ORACLE_SQL as ORACLE_SQL


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out()
    model = langid.fit(docs, ~held & F.col("doc_id").isNotNull())
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.digest(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers as public

    own = packing.Tokenizer.read(tokenizer or public.path("byte_bpe_50k.json"), public.PATTERN)
    return packing.pack(table(spark, sf_dir, "documents"), own, capacity=1024, end=0)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op10_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers as public

    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.codec(ranks or public.path("byte_bpe_50k.tiktoken"), public.PATTERN))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_chat_rotation, op4_pii, op5_secrets, op6_simhash, op7_packing, op8_licenses, op9_embeddings, op10_bpe)}
