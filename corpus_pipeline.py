"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of documents.  Empty tables, null texts and repeated rows pass through as each
stage's operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontam, mixing, ngram_join, quality, token_files
from gridloom.llm.queries import END_ID, tokenizer_path
from gridloom.session import scratch_path, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voted quality rules keep."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity: the smallest id."""
    return ngram_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, as read back: a row for each document in them."""
    path = scratch_path(spark, "pipeline-token-files")
    token_files.write_token_files(docs, path, tokenizer_path(), END_ID)
    return token_files.token_file_digests(spark, path)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("token_files", encode_tokens),
]

#: SQL has no expectation-maximisation and no tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
