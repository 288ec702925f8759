import re
import zlib

import duckdb
import numpy as np
from test_ngram_join import brute as linked
from test_quality import brute_estimate
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import decontam, ngram_join, quality, queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA).checkpoint()
        assert docs.columns == columns
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality.judge(before).where("kept").collect()}
        if name == "ngram_jaccard_join":
            left = ngram_join.link_documents(docs)
            assert left.where("id <> component_id").count() == 0
            assert docs.count() == ngram_join.link_documents(before).select("component_id").distinct().count()
        if name == "benchmark_decontamination":
            assert decontam.find_leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count()


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).checkpoint()
    assert docs.collect() == []


def test_run_against_plain_python(spark):
    """What run() returns, step by step from the texts: one process, no Spark but for the votes and the leaks, which have tests of their own."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    voted = docs.select("doc_id", quality.votes_of(quality.measures(docs.text)).alias("v")).where("v is not null").collect()
    patterns = sorted((tuple(r.v), 1) for r in voted)
    p, g, b = brute_estimate(patterns)
    kept = []
    for r in voted:
        x, y = p, 1 - p
        for v, good, bad in zip(r.v, g, b):
            x, y = (x * good, y * bad) if v < 0 else (x * (1 - good), y * (1 - bad)) if v > 0 else (x, y)
        kept += [r.doc_id] * (x >= y)
    kept = [i for i, _, c in map(eval, linked([(i, texts[i]) for i in sorted(kept)])) if i == c]
    leaking = {r.doc_id for r in decontam.find_leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    kept = [i for i in kept if i not in leaking]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet' WHERE doc_id IN ({','.join(map(str, kept))})")
    mixed = []
    for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({queries.OP1_SQL})").fetchall():
        mixed += [(i, texts[i])] * (taken // size if size else 0)
        if size and taken % size:
            mixed.append((i, texts[i][: [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i])][taken % size - 1]]))
    plain, start, expected = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for i, text in sorted(mixed):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect())
    assert found == expected and len(found) > 100
