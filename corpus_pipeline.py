"""The corpus pipeline over ``documents``.

Stages in order: language ID (documents without an identified language go),
quality rules (documents that break one go), SimHash near-duplicates (one document
of each group stays), personal data (spans are replaced in the text), packing.
Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Null keys, texts and languages, empty tables, repeated rows and further columns
have the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import langid, packing, pii, quality, simhash
from quillon.llm.common import materialize, release, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    return langid.keep_identified(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return packing.pack(docs, packing.Tokenizer.read(public.path("byte_bpe_50k.json"), public.PATTERN))


STAGES = [
    ("language", language),
    ("quality", rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Trained models, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the last one's pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
