"""Token counts with a cache of digests.

A count belongs to the digest of a text's content and the digest of the tokenizer file.
Counts already stored are joined; only the distinct texts that miss are encoded, and
their counts are appended to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .tokenizing import encoder, tokenizer_version

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens bigint"


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; empty where nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text in ``out_col``.

    Null counts as the empty text.  All columns and rows of ``docs`` stay, repeated ones
    too; a column that already has the name ``out_col`` is replaced.  The content is not
    changed before it is digested, since any normalising could change a count.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    content = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(content, 256)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            counts = [len(ids) // 4 for ids in enc.encode(x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    # Copies meet in each map task before the shuffle, so a text with very many copies
    # sends one row from each task.
    distinct = docs.select(digest.alias("digest"), content.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest")
    known_before = not known.isEmpty()
    counted = distinct.join(known, "digest", "left_anti").mapInArrow(encode, "digest string, n_tokens bigint")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)

    keep = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out_col])
    # Runs that overlap may have stored a digest twice.  The counts of these texts are written,
    # so that a text with very many copies is a skewed side of the join, which Spark can split.
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    counts = stored.groupBy("digest").agg(F.max("n_tokens").alias("_n_tokens"))
    if known_before:
        counts = counts.join(docs.select(digest.alias("digest")).distinct(), "digest", "left_semi")
    counts = Scratch(spark, "token-counts").keep("counts", counts)
    joined = docs.select(keep.alias("_row"), digest.alias("digest")).join(counts, "digest", "left")
    return joined.select("_row.*", F.col("_n_tokens").alias(out_col))
