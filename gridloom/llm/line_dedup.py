"""Removing lines that repeat across documents.

Two Bloom filters hold the hashes of line keys seen once and seen twice.  Only documents'
lines that the second filter suspects are shuffled, for exact confirmation and the choice
of the first document that holds each; filters can only suspect too much, so the result is
exact at every filter size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch

#: Bits of each filter; the second one goes to every worker, so this bounds the broadcast.
FILTER_BITS = 1 << 28
#: A hash sets all its bits within one block, so blocks are built apart.
BLOCK_BITS = 1 << 16
HASHES = 4
_SPACE = b" \t\n\r\x0b\x0c"


def line_key(line: bytes) -> bytes:
    """A line without the six ASCII white-space characters at its ends, A-Z lowered."""
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash within its block, from its low 48 bits."""
    steps = (hashes >> np.uint64(24)) & np.uint64((1 << 24) - 1) | np.uint64(1)
    return ((hashes & np.uint64((1 << 24) - 1))[:, None] + np.arange(HASHES, dtype=np.uint64) * steps[:, None]) % np.uint64(BLOCK_BITS)


def _blocks(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(48)) * np.uint64(n_blocks)) >> np.uint64(16)


class SeenTwice:
    """The blocks of the second filter; one without a block suspects nothing there."""

    def __init__(self, blocks: dict[int, bytes], n_blocks: int):
        self.n_blocks = n_blocks
        self._packed = blocks
        self._rows: np.ndarray | None = None

    def __getstate__(self):
        return self._packed, self.n_blocks, None

    def __setstate__(self, state):
        self._packed, self.n_blocks, self._rows = state

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        if self._rows is None:
            self._at = np.zeros(self.n_blocks, dtype=np.int64)
            self._at[list(self._packed)] = np.arange(len(self._packed)) + 1
            self._rows = np.zeros((len(self._packed) + 1, BLOCK_BITS // 8), dtype=np.uint8)
            for i, packed in enumerate(self._packed.values()):
                self._rows[i + 1] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        rows = self._at[_blocks(hashes, self.n_blocks).astype(np.int64)]
        bits = _bits(hashes)
        found = self._rows[rows[:, None], bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1
        return found.all(axis=1)


def _doc_keys(text: str | None, min_chars: int) -> set[bytes]:
    keys = {line_key(x) for x in (text or "").encode().split(b"\n")}
    return {k for k in keys if _long_enough(k, min_chars)}


def seen_twice(docs: DataFrame, min_chars: int, filter_bits: int, text_col: str = "text") -> SeenTwice:
    """Filter of the keys that at least two rows of ``docs`` hold."""
    n_blocks = max(1, filter_bits // BLOCK_BITS)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [xxhash.xxh3_64_intdigest(k) for text in batch.column(0) for k in _doc_keys(text.as_py(), min_chars)]
            # One row for each hash of a batch, so frequent lines send few.
            values, counts = np.unique(np.array(found, dtype=np.uint64), return_counts=True)
            arrays = [_blocks(values, n_blocks).astype(np.int32), values.view(np.int64), counts > 1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["block", "hash", "twice"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # FILTER_BITS / 8 bytes each, of which only the pages of this task's blocks are touched.
        once = np.zeros((n_blocks, BLOCK_BITS // 8), dtype=np.uint8)
        twice = np.zeros_like(once)
        for batch in batches:
            hashes = batch.column(1).to_numpy().view(np.uint64)
            values, first, n = np.unique(hashes, return_index=True, return_counts=True)
            rows = batch.column(0).to_numpy()[first].astype(np.int64)[:, None]
            bits = _bits(values)
            at, bit = (rows, (bits >> np.uint64(3)).astype(np.int64)), np.uint8(1) << (bits & np.uint64(7)).astype(np.uint8)
            again = (once[at] & bit != 0).all(axis=1) | (n > 1)
            again |= np.isin(values, hashes[batch.column(2).to_numpy(zero_copy_only=False)])
            np.bitwise_or.at(once, at, bit)
            np.bitwise_or.at(twice, (rows[again], at[1][again]), bit[again])
        kept = [(b, zlib.compress(twice[b].tobytes(), 1)) for b in np.flatnonzero(twice.any(axis=1)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in kept], pa.int32()), pa.array([x for _, x in kept], pa.binary())], names=["block", "bits"])

    rows = docs.select(text_col).mapInArrow(hashes, "block int, hash bigint, twice boolean")
    blocks = rows.repartition("block").mapInArrow(build, "block int, bits binary")
    # At most FILTER_BITS / 8 bytes in all, whatever the number of lines.
    return SeenTwice({r["block"]: bytes(r["bits"]) for r in blocks.toLocalIterator()}, n_blocks)


def repeated_lines(docs: DataFrame, min_chars: int = 10, filter_bits: int = FILTER_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key hash of two bigints, id): the documents that lose the lines of a key.

    These are all that hold the key but the one with the smallest id.  A null id comes after
    all others; null and empty texts hold no key, and an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    twice = spark.sparkContext.broadcast(seen_twice(docs, min_chars, filter_bits, text_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for i, text in enumerate(batch.column(1)):
                own = _doc_keys(text.as_py(), min_chars)
                keys.extend(own)
                owners.extend([i] * len(own))
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
            found = np.flatnonzero(twice.value.suspects(hashes)) if len(keys) else np.zeros(0, dtype=np.int64)
            wide = np.frombuffer(b"".join(xxhash.xxh3_128_digest(keys[i]) for i in found), dtype="<i8").reshape(-1, 2)
            ids = batch.column(0).take(pa.array(np.array(owners, dtype=np.int64)[found]))
            yield pa.RecordBatch.from_arrays([pa.array(wide[:, 0].copy()), pa.array(wide[:, 1].copy()), ids], names=["k1", "k2", "id"])

    scratch = Scratch(spark, "line-dedup")
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(suspects, f"k1 bigint, k2 bigint, id {id_type}")
    held = scratch.keep("held", held)
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))  # null ids come last
    firsts = held.groupBy("k1", "k2").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first < last")
    # Written before it is joined, so that a line of very many documents is a skewed side which Spark can split.
    losing = held.join(scratch.keep("firsts", firsts), ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("first.id")))
    return losing.select("k1", "k2", "id")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, filter_bits: int = FILTER_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines whose key another document with a smaller id holds.

    Columns of ``docs`` may have any names; n_lines and n_dropped are replaced.

    Keys of at least ``min_chars`` code points count.  A document that holds a key first
    keeps all its lines of it.  Adds n_lines (before dropping) and n_dropped; the rest of
    the lines are joined by ``\\n``.  Null text becomes one empty line.  Rows with equal ids
    are one document; a null id comes after all others.
    """
    losing = repeated_lines(docs, min_chars, filter_bits, id_col, text_col)
    lost = losing.groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("k1", "k2")).alias("_lost"))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"), F.col(id_col).alias("_own"))
    schema = T.StructType([rows.schema["_row"]]).add("_text", "string").add("_n_lines", "long").add("_n_dropped", "long")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(batch.column(1), batch.column(2)):
                lines = (text.as_py() or "").split("\n")
                n_lines.append(len(lines))
                if lost.is_valid:
                    gone = {np.array([x["k1"], x["k2"]], dtype="<i8").tobytes() for x in lost.as_py()}
                    lines = [x for x in lines if xxhash.xxh3_128_digest(line_key(x.encode())) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append("\n".join(lines))
            added = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *added], names=schema.names)

    joined = rows.join(lost, F.col("_own").eqNullSafe(F.col("_id")), "left").select("_row", "_text", "_lost")
    kept = joined.mapInArrow(rebuild, schema)
    return kept.select("_row.*", F.col("_text").alias(text_col), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))
