"""The corpus pipeline: language ID, exact dedup, near dedup, mixing and packing of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.exact_dedup import drop_copies
from ledgerloom.llm.jaccard_join import one_of_each
from ledgerloom.llm.language_id import in_some_language
from ledgerloom.llm.mixing import mixed
from ledgerloom.llm.packing import pack
from ledgerloom.llm.queries import tokenizer_file
from ledgerloom.llm.shared import stage


#: The languages that the corpus is to hold.
LANGUAGES = ("de", "en", "es", "fr")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose language, as predicted, is wanted; those with no letter have none."""
    return in_some_language(docs, LANGUAGES)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return drop_copies(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles of five words at a similarity of 0.8 the first stays."""
    return one_of_each(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL expresses neither the language models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"stage{k}")
    return docs
