"""Byte-level BPE from a file of merge ranks: texts to ids, and ids back to bytes.

A text is split by the vocabulary's pattern, and each match is merged apart
(``rank_queue``).  A worker remembers the ids of words between single spaces, so that the
pattern and the merges run once for each different word.  That is exact: a space between
two characters that are none begins the next match, and no match goes on over it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank_queue import Merger

#: Words, and matches, whose ids a worker remembers before it forgets those not in use; bounds its memory.
WORDS_KEPT = 300_000
#: Characters of texts encoded together.
CHARS_AT_ONCE = 4_000_000

_APART = re.compile(r"(?<=\S) (?=\S)")
_CODECS: dict[tuple[str, str], ByteBpe] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks: a line has a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        self._ranks = read_ranks(path)
        self._matches = regex.compile(pattern).findall
        self._words: dict[str, bytes] = {}
        self._made: dict[bytes, bytes] = {}
        self._tokens = [b""] * (max(self._ranks.values()) + 1)
        for token, rank in self._ranks.items():
            self._tokens[rank] = token
        self._known = np.zeros(len(self._tokens), dtype=bool)
        self._known[list(self._ranks.values())] = True
        self.decimal = [str(i) for i in range(len(self._tokens))]

    @cached_property
    def _whole(self) -> dict[bytes, bytes]:
        return {t: np.array([r], dtype="<u4").tobytes() for t, r in self._ranks.items()}

    @cached_property
    def _merger(self) -> Merger:
        return Merger(self._ranks)

    def _ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the pattern and the merges."""
        whole, findall = self._whole, self._matches
        # Plain letters after a space, if any, are one match; most words are that.
        split = [(t.encode(),) if (w := t.removeprefix(" ")).isalpha() and w.isascii() else tuple(m.encode() for m in findall(t)) for t in texts]
        wanted = {m for ms in split for m in ms if m not in whole}
        if len(self._made) + len(wanted) > WORDS_KEPT:  # those in use are kept
            self._made = {m: self._made[m] for m in wanted if m in self._made}
        made = self._made
        new = [m for m in wanted if m not in made]
        made.update(zip(new, self._merger.merge(new)))
        return [(whole.get(ms[0]) or made[ms[0]]) if len(ms) == 1 else b"".join([whole.get(m) or made[m] for m in ms]) for ms in split]

    def _learn(self, heads: list[str], wanted: set[str]) -> list[bytes]:
        """The ids of ``heads``, which follow nothing; has those of ``wanted``, which follow a space."""
        new = [w for w in wanted if w not in self._words]
        if len(self._words) + len(new) > WORDS_KEPT:  # those in use are kept
            self._words = {w: self._words[w] for w in wanted.difference(new)}
        ids = self._ids([*heads, *(" " + w for w in new)])
        self._words.update(zip(new, ids[len(heads) :]))
        return ids[: len(heads)]

    def _encode_cut(self, cut: list[list[str]]) -> list[bytes]:
        heads = self._learn([c[0] for c in cut], {w for c in cut for w in c[1:]})
        return [head + b"".join(map(self._words.__getitem__, c[1:])) for head, c in zip(heads, cut)]

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        odd = {w for w in set().union(*cut) if not w or w[0].isspace() or w[-1].isspace()}
        apart = [i for i, c in enumerate(cut) if not odd.isdisjoint(c)]
        for i in apart:  # white space beside a space
            cut[i] = _APART.split(texts[i])
        return self._encode_cut(cut)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null counts as empty."""
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= CHARS_AT_ONCE:
                yield from self._encode_some(some)
                some, size = [], 0
        yield from self._encode_some(some)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``; an id that the vocabulary lacks is an error."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self._tokens) and self._known[ids].all()):
            raise ValueError("an id that the vocabulary does not have")
        return b"".join(map(self._tokens.__getitem__, ids.tolist()))


def codec(path: str, pattern: str) -> ByteBpe:
    """This process's codec for a file of ranks and a pattern."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(path, pattern)
    return _CODECS[path, pattern]


def _over(docs: DataFrame, column: str, out_col: str, kind: str, change) -> DataFrame:
    """``docs`` with ``out_col`` made from ``column`` by ``change``, an Arrow array to another."""
    rest = [c for c in docs.columns if c != out_col]
    given = docs.select(F.col(f"`{column}`").alias("_in"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"))
    fields = given.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), change(batch.column(0))], names=["_row", "_out"])

    return given.mapInArrow(run, f"_row {fields}, _out {kind}").select("_row.*", F.col("_out").alias(out_col))


def _lists(values: list[bytes]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(v) // 4 for v in values]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(values), dtype="<i4")))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text in ``out_col`` (array<int>).

    A null or empty text has no ids.  All rows and other columns stay, repeated rows too; a
    column that already has the name ``out_col`` is replaced.  Strings that name special
    tokens are ordinary text.
    """
    return _over(docs, text_col, out_col, "array<int>", lambda c: _lists(list(codec(path, pattern).encode(x.as_py() for x in c))))


def decode(coded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """``coded`` with the bytes that its ids stand for in ``out_col`` (binary).

    Null counts as no ids; ids cut out of a text may give bytes that are no whole
    characters.  An id that the vocabulary lacks, or a null one, fails the job.  Rows and
    columns stay as in ``encode``.
    """

    def change(column: pa.ListArray) -> pa.Array:
        own, out = codec(path, pattern), []
        for ids in column:
            out.append(own.decode(ids.values.to_numpy(zero_copy_only=False)) if ids.is_valid else b"")
        return pa.array(out, pa.binary())

    return _over(coded, ids_col, out_col, "binary", change)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The digests are of what ``encode`` and ``decode`` give for it, the ids as decimals with
    commas between; ids and bytes stay in the tasks.  Nulls and repeated rows as there.
    """
    given = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for code in own.encode(x.as_py() for x in batch.column(1)):
                ids = np.frombuffer(code, dtype="<u4")
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return given.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
