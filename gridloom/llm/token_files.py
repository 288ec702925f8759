"""Token-ID files: Simple-8b segments in global id order, and their reader.

A dataset of token files is a Parquet folder, so that Spark's committers place it in any
store and a task that is run again replaces its own output.  Each row is a segment: the
documents it holds, their lengths in ids, and the ids as one Simple-8b byte string
(``simple8b``), whose blocks decode on their own.  Segments are ordered by
(``part``, ``segment``); documents never span segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import simple8b
from .tokenizing import encoder

#: Ids after which a segment is closed; a longer document has a segment to itself.
SEGMENT_IDS = 1 << 17


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text and write the ids in ascending ``id_col`` order at ``path``.

    Null texts count as empty; with ``end_id`` each document ends with that id.  Rows with
    equal ids keep together, ordered by text; null ids come first.  An empty table writes a
    readable empty dataset.  Other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"part int, segment int, ids_before bigint, n_ids bigint, doc_ids array<{id_type}>, lengths array<bigint>, payload binary"
    ending = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        segment = before = size = 0
        ids, docs_in, id_arrow = [], [], None

        def close() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), dtype="<u4")
            lengths = [len(x) // 4 for x in ids]
            row = [[part], [segment], [before], [len(values)], pa.array([docs_in], pa.list_(id_arrow)), [lengths], [simple8b.pack(values)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays(
                [x if k is None else pa.array(x, k) for x, k in zip(row, kinds)],
                names=["part", "segment", "ids_before", "n_ids", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            id_arrow = batch.column(0).type
            for doc_id, code in zip(batch.column(0).to_pylist(), enc.encode(x.as_py() for x in batch.column(1))):
                ids.append(code + ending)
                docs_in.append(doc_id)
                size += len(ids[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield close()
                    segment, before, size = segment + 1, before + size, 0
                    ids, docs_in = [], []
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ranged.mapInArrow(encode, schema).write.option("parquet.block.size", 32 << 20).option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the token files at ``path``.

    Columns: the document's id, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids`` (array<int>) and ``ids_crc32`` (unsigned CRC-32 of the ids as little-endian
    unsigned 32-bit integers).
    """
    return _decoded(spark, path, True)


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_token_files`` without the ids themselves, which then stay in the tasks."""
    return _decoded(spark, path, False)


def _decoded(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    files = spark.read.parquet(path)
    id_type: T.ArrayType = files.schema["doc_ids"].dataType
    schema = f"part int, at bigint, doc_id {id_type.elementType.simpleString()}, n_tokens bigint, ids_crc32 bigint"
    schema += ", ids array<int>" if with_ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, doc_ids, lengths, payload = (c[i] for c in batch.columns)
                values = simple8b.unpack(payload.as_buffer()).astype("<u4")
                sizes = lengths.values.to_numpy()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                out = [
                    pa.array(np.full(len(sizes), part.as_py()), pa.int32()),
                    pa.array(before.as_py() + starts, pa.int64()),
                    doc_ids.values,
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(values[a:b]) for a, b in zip(starts, ends)], pa.int64()),
                ]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(values.astype("<i4"))))
                yield pa.RecordBatch.from_arrays(out, names=["part", "at", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(out)])

    # One row for each task that wrote: its size is bounded by the number of partitions.
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    docs = files.select("part", "ids_before", "doc_ids", "lengths", "payload").mapInArrow(decode, schema)
    rest = ["n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), *rest)
