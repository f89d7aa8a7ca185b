"""A training corpus from raw documents: no toxic documents, one of each group of near-duplicates, no personal data, packed.

Each stage works on all rows that the stage before it kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tideway.llm import bagminhash, best_fit_packing, pii, toxicity
from tideway.llm.common import kept


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(toxicity.training_rows(docs, labels)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return bagminhash.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every found span of personal data replaced by its kind, and the new length."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of tokens."""
    return best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash near-dedup", without_near_duplicates),
    ("pii", without_personal_data),
    ("best-fit packing", packed),
]

#: SQL can express neither the learned scores nor the signatures; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", frees=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
