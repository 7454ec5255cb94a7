"""A corpus pipeline of five stages, each one of the operators at work on what the one before kept.

Every stage but the last returns the columns of documents; what it decides takes
effect there. Labels for the first stage come from the labels table beside the
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard_join, packing, quality_rules, queries, secrets, toxicity
from lodestone.llm.common import materialize, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples don't make them toxic."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return quality_rules.keep_good(docs)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 tokens: the place of every piece of every document."""
    return packing.pack_documents(docs, queries.tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_alike),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Nearest neighbours, expectation-maximisation and packing are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
