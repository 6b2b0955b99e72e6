"""A corpus pipeline of the operators: quality, toxicity, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The filters return the columns of ``documents``
unchanged; the last stage returns pieces with their places in packed sequences. Each operator's docstring says what becomes of
nulls, empty and very long texts, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import near_dedup, packing, quality, toxicity
from tidemark.llm.common import written
from tidemark.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling takes."""
    return quality.sampled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text does not score as toxic."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return near_dedup.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_dedup", distinct), ("packing", packed)]

#: The classifiers are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
