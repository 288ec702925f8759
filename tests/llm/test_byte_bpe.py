"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import byte_bpe, queries
from gridloom.llm.rank_queue import LONG_PIECE, Merger, RankBitmap, RankQueue
from tests.llm.test_queries import DATA, duck  # noqa: F401

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def ids_of(code):
    return np.frombuffer(code, dtype="<u4").tolist()


def test_bitmap_gives_the_least():
    r, bits, had = random.Random(3), RankBitmap(50_000), set()
    for _ in range(5_000):
        if r.random() < 0.6:
            x = r.randrange(50_000)
            bits.add(x)
            had.add(x)
        elif had:
            x = r.choice(sorted(had))
            bits.remove(x)
            had.remove(x)
        assert bits.first() == min(had, default=-1)
    one = RankBitmap(1)
    assert one.first() == -1
    one.add(0)
    assert one.first() == 0


def test_queue_gives_leftmost_of_lowest():
    queue = RankQueue(300)
    for rank, place in [(7, 5), (7, 2), (260, 1), (7, 9), (3, 8)]:
        queue.push(rank, place)
    assert list(queue.places()) == [(3, 8), (7, 2), (7, 5), (7, 9), (260, 1)]


def plain_merge(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_whose_results_have_lower_ranks():
    """Ranks in no order of making, so that a merge may open one that comes before it."""
    r = random.Random(5)
    for _ in range(40):
        tokens = {bytes([b]) for b in range(256)} | {bytes(r.choice(b"ab") for _ in range(r.randrange(2, 6))) for _ in range(12)}
        order = sorted(tokens)
        r.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        merger = Merger(ranks)
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randrange(0, 30))) for _ in range(30)]
        pieces += [bytes(r.choice(b"ab") for _ in range(LONG_PIECE + 20))]
        assert [ids_of(x) for x in merger.merge(pieces)] == [plain_merge(ranks, p) for p in pieces]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "the", " ", "  ", "\n", "\t", "'s", "é", "日", "1", "!", "\x1c", "\x85", " ", "　", "🎉"]), max_size=40).map("".join), max_size=8))
def test_texts_against_library(library, texts):
    own = byte_bpe.codec(PATH, P.PATTERN)
    codes = list(own.encode(texts))
    assert [ids_of(c) for c in codes] == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(np.frombuffer(c, dtype="<u4")) for c in codes] == [t.encode() for t in texts]


@pytest.mark.parametrize("text", ["y" * 20_000, "ab" * 9_000, " " * 5_000, "日本" * 4_000, "!?" * 5_000 + " x", "12" * 3_000])
def test_very_long_matches(library, text):
    own = byte_bpe.codec(PATH, P.PATTERN)
    assert ids_of(next(own.encode([text]))) == library.encode_ordinary(text)


def test_words_forgotten_and_learnt_again(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WORDS_KEPT", 50)
    monkeypatch.setattr(byte_bpe, "CHARS_AT_ONCE", 300)
    own = byte_bpe.ByteBpe(PATH, P.PATTERN)
    texts = [" ".join(f"w{i * j % 97}" for j in range(40)) for i in range(30)]
    assert [ids_of(c) for c in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_operators_on_odd_rows(odd, odd_rows, library):
    both = byte_bpe.decode(byte_bpe.encode(odd, PATH, P.PATTERN), PATH, P.PATTERN)
    assert both.columns == [*odd.columns, "ids", "bytes"]
    found = sorted(((r.doc_id, r.text, r.ids, bytes(r.bytes)) for r in both.collect()), key=str)
    assert found == sorted(((i, t, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in odd_rows), key=str)


def test_empty_and_null(spark, empty):
    assert byte_bpe.encode(empty, PATH, P.PATTERN).collect() == []
    assert byte_bpe.round_trip_digests(empty, PATH, P.PATTERN).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(byte_bpe.decode(nulls, PATH, P.PATTERN).first().bytes) == b""
    with pytest.raises(ValueError):
        byte_bpe.codec(PATH, P.PATTERN).decode(np.array([99_999]))


def test_query(spark, duck, library):  # noqa: F811
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = {}
    for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode_ordinary(t or "")
        expected[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))
    found = queries.op11_byte_bpe(spark, DATA).collect()
    assert len(found) == len(expected)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == expected
