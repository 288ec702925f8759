import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import simple8b, token_counts, token_files, tokenizing
from gridloom.llm.queries import tokenizer_path
from gridloom.session import scratch_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,'!aBé19\u00a0\u2003\u200b\u0301漢🙂<|>", max_size=40), max_size=8))
def test_pieces_join_to_the_whole(texts):
    enc, plain = tokenizing.encoder(PATH), Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [ids(plain, t) for t in texts]


def test_remembered_pieces_are_bounded(monkeypatch, odd_rows):
    monkeypatch.setattr(tokenizing, "PIECES_KEPT", 50)
    monkeypatch.setattr(tokenizing, "CHARS_AT_ONCE", 500)
    enc, plain = tokenizing.TextEncoder(PATH), Tokenizer.from_file(PATH)
    texts = [r[1] for r in odd_rows]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [ids(plain, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(values):
    data = simple8b.pack(np.array(values, dtype=np.uint64))
    assert simple8b.unpack(data).tolist() == values
    size = simple8b.BLOCK
    assert simple8b.unpack(data, 1, 3).tolist() == values[size : 3 * size]


def test_counts_and_cache(spark, odd, odd_rows, plain):
    cache = scratch_path(spark, "cache")
    wide = odd.withColumns({"digest": F.lit("clash"), "n_tokens": F.lit("old")})
    expected = sorted((r[0] is None, r[0] or 0, len(ids(plain, r[1]))) for r in odd_rows)
    for _ in range(2):
        found = token_counts.count_tokens(wide, PATH, cache)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in found.collect()) == expected
        assert sorted(found.columns) == sorted(wide.columns)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in odd_rows})


def test_other_tokenizers(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(0, "The cat, the dog."), (1, None), (2, " a  b ")], "doc_id long, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path, scratch_path(spark, "cache")).collect()}
    assert found == {0: len(model.encode("The cat, the dog.")), 1: 0, 2: len(model.encode(" a  b "))}


@pytest.mark.parametrize("segment", [50, 1 << 17])
def test_files_round_trip(spark, odd, odd_rows, plain, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(odd, path, PATH, end_id=2)
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, start = [], 0
    for r in rows:
        code = [*ids(plain, r[1]), 2]
        expected.append((r[0], start, len(code), zlib.crc32(np.array(code, "<u4").tobytes()), code))
        start += len(code)
    found = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in found] == expected
    assert token_files.token_file_digests(spark, path).count() == len(rows)


def test_empty(spark, empty):
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(empty, path, PATH, end_id=2)
    assert token_files.read_token_files(spark, path).collect() == []
    assert token_counts.count_tokens(empty, PATH, scratch_path(spark, "cache")).collect() == []
