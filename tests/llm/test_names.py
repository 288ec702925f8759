"""Extra columns of any name: results are those without them."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, html_extract, line_dedup, mixing, ngram_join, quality, queries, token_counts, token_files, toxicity, url_filter
from gridloom.session import scratch_path

TEXTS = ["The town of the river was old and the people of it went to the market for bread and wine.", "A line that both hold\nand one more of its own here", "A line that both hold\nx", None, "", "How many apples does Anna have if she had 12 and gave 5 of them to Bob?"]


def files(d):
    path = scratch_path(d.sparkSession, "names")
    token_files.write_token_files(d, path, queries.tokenizer_path(), 2)
    return token_files.token_file_digests(d.sparkSession, path)


def bench(d):
    return d.sparkSession.createDataFrame([(1, TEXTS[5])], "item_id long, text string")


OPERATORS = {
    mixing: lambda d: mixing.mix(d),
    toxicity: lambda d: toxicity.score(d, *toxicity.fit(d, d.select("doc_id").withColumn("toxic", (F.col("doc_id") == 1).cast("int")))),
    quality: lambda d: quality.judge(d).join(quality.keep_good(d).select("doc_id"), "doc_id", "left_semi"),
    token_counts: lambda d: token_counts.count_tokens(d, queries.tokenizer_path(), scratch_path(d.sparkSession, "names")),
    html_extract: lambda d: html_extract.extract_text(d, html_col="text", out_col="main"),
    url_filter: lambda d: url_filter.judge_urls(d, queries.URL_RULES, url_col="text"),
    line_dedup: lambda d: line_dedup.drop_repeated_lines(d, filter_bits=1 << 20),
    token_files: files,
    ngram_join: lambda d: ngram_join.keep_one(d),
    decontam: lambda d: decontam.drop_leaks(d, bench(d)).join(decontam.find_leaks(d, bench(d)).select("doc_id"), "doc_id", "left_anti"),
}


@pytest.mark.parametrize("module", OPERATORS, ids=lambda m: m.__name__)
def test_columns_named_as_helpers(spark, module):
    """Every name in quotes in the operator's own code is a column of the documents as well."""
    plain = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    names = set(re.findall(r'"(_?[a-z][a-z0-9_]*)"', Path(module.__file__).read_text())) - {"doc_id", "text", "source"}
    wide = plain.withColumns({n: F.lit("clash") for n in sorted(names)})
    expected, found = OPERATORS[module](plain), OPERATORS[module](wide)
    shared = [c for c in expected.columns if c in found.columns and (c not in names or module not in (html_extract,))]
    assert "doc_id" in shared
    rows = lambda d: sorted(str([r[c] for c in shared]) for r in d.collect())
    assert rows(found) == rows(expected)
    assert set(expected.columns) <= set(found.columns)
