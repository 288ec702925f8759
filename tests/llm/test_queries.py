"""The registered queries on the smallest dataset: against DuckDB where there is SQL, else against brute force."""

import html
import re
import zlib

import duckdb
import numpy as np
import pytest

from gridloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_against_sql(spark, duck, name):
    found = queries.queries()[name](spark, DATA)
    expected = duck.execute(queries.oracle_sql()[name])
    order = [c[0] for c in expected.description]
    assert sorted(order) == sorted(found.columns)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in found.collect()))) == sorted(map(str, expected.fetchall()))


def test_token_queries(spark, duck):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    code = {i: plain.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op4_token_counts(spark, DATA).collect()}
    assert counts == {i: (len((texts[i] or "").encode()), len(c), len(c) > 512) for i, c in code.items()}
    start = 0
    files = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_files(spark, DATA).collect()}
    for i in sorted(code):
        ids = [*code[i], 2]
        assert files[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_html_query(spark, duck):
    """These pages mark their article, which has no element inside that is dropped."""
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op5_html_extraction(spark, DATA).collect()}
    for page, url, source in duck.execute("SELECT page_id, url, html FROM pages").fetchall():
        article = source.partition("<article>")[2].partition("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", article).replace("<br>", " "))
        text = "\n\n".join(b for x in blocks if (b := " ".join(html.unescape(x).split())))
        assert found[page] == (url, text, len(text))


def test_leaks_query(spark, duck):
    words = re.compile(r"[^\W_]+")
    flat = lambda t: " " + " ".join(words.findall((t or "").lower())) + " "
    items = {i: flat(t) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()}
    docs = {i: flat(t) for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    whole = {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}
    assert whole == {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, DATA).collect()}


def test_toxicity_query(spark, duck):
    marked = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    found = {r.doc_id: r.toxic for r in queries.op2_toxicity(spark, DATA).collect()}
    assert len(found) == duck.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    clean = [i for i, t in marked.items() if not t]
    assert sum(found[i] for i in clean) <= 0.03 * len(clean)
