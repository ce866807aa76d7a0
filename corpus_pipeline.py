"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of ``documents``.  A stage's table is written as parquet and
read again as the next one's ``docs``.

Null, empty and blank texts pass every stage but the last, where they are a
piece with the end id alone.  Rows of one doc_id are told apart by their text and equal
rows leave one in the third stage; null doc_ids never win a group from others.  Other columns pass unchanged, whatever
their names; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctrlspark.llm import decontaminate, line_dedup, ngram_join, packing, quality
from ctrlspark.llm.staging import staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity passes their language's threshold; the model is trained on the trusted ones among them."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an equal or similar line precedes (Jaccard of words 0.8 or more)."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, threshold="0.8")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words inside benchmark windows of 13 words."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens: a row for each piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: tokenisation and the trained model are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
