"""Token ids as length-delimited binary records, with an offset index.

A file is a run of frames::

    length   u64 little-endian
    check    u32 masked CRC-32 of the eight bytes before
    payload  `length` bytes
    check    u32 masked CRC-32 of the payload

A frame of length zero is a mark between blocks that readers skip.  A payload is
a header (shard u64, ids of the shard before it u64, document id i64, flags u8)
and the ids, as u16 where all fit, else as u32.  Flag 1: wide ids; flag 2: the
document has no id.  Files are written by Spark's own writer, so a task that
runs again replaces its file, and any file system of Spark's will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

SHARD_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20
_HEAD = struct.Struct("<QQqB")
_WIDE, _NO_ID = 1, 2


def masked(data: bytes) -> int:
    """CRC-32, rotated and offset, so that a checksum over checksums stays useful."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join(
        (length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)))
    )


MARK = frame(b"")


class CorruptRecord(ValueError):
    """A frame's checksum or length is wrong."""


def frames(data: bytes | memoryview) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of each frame but for marks; checks both checksums."""
    view, at = memoryview(data), 0
    while at < len(view):
        if at + 16 > len(view):
            raise CorruptRecord(f"frame cut off at byte {at}")
        (length,) = struct.unpack_from("<Q", view, at)
        (check,) = struct.unpack_from("<I", view, at + 8)
        if check != masked(view[at : at + 8]):
            raise CorruptRecord(f"length check fails at byte {at}")
        end = at + 12 + length
        if end + 4 > len(view):
            raise CorruptRecord(f"frame cut off at byte {at}")
        payload = view[at + 12 : end]
        if struct.unpack_from("<I", view, end)[0] != masked(payload):
            raise CorruptRecord(f"payload check fails at byte {at}")
        if length:
            yield at, payload
        at = end + 4


def encode_record(shard: int, before: int, doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = wide * _WIDE | (doc_id is None) * _NO_ID
    return _HEAD.pack(shard, before, doc_id or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()


def decode_record(payload: memoryview) -> tuple[int, int, int | None, np.ndarray]:
    """(shard, ids of the shard before it, document id, ids as u32)."""
    shard, before, doc_id, flags = _HEAD.unpack_from(payload, 0)
    ids = np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=_HEAD.size).astype("<u4")
    return shard, before, None if flags & _NO_ID else doc_id, ids


def write_records(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Tokenize all documents and write their records in ascending ``doc_id``.

    A range partitioning gives shard after shard; a shard's task encodes and
    writes its documents as it reads them.  Null ids come first; equal ids are
    ordered by the beginnings of their texts, then by a hash, and are dealt to as many shards as
    they need, so that very many rows with one id or without one are no large file.  A null
    or empty text has the end id alone.  Ids are long integers, as the format
    has them: other numbers are cast, and an id that can't be is an error.
    """
    common.prepare(docs.sparkSession)
    own = common.only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    shards = common.pieces(common.text_size(own, "text"), shard_bytes)

    def run(batches):
        enc = encoder(vocabulary)
        shard, before = TaskContext.get().partitionId(), 0
        block, size = [], 0
        for batch in batches:
            ids, edges = enc.encode([t or "" for t in batch.column(1).to_pylist()], end_id)
            edges = edges.tolist()
            for d, at, end in zip(batch.column(0).to_pylist(), edges, edges[1:]):
                block.append(frame(encode_record(shard, before, d, ids[at:end])))
                before += end - at
                size += len(block[-1])
                if size >= BLOCK_BYTES:
                    yield common.record_batch(block=pa.array([b"".join(block)], pa.binary()))
                    block, size = [], 0
        if block:
            yield common.record_batch(block=pa.array([b"".join(block)], pa.binary()))

    order = ["doc_id", "start", "hash", "row"]
    tied = own.withColumns({"start": F.left("text", F.lit(16)), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = tied.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = common.map_arrow(ranged, run, "block binary")
    (
        blocks.select(F.col("block").cast("string"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", MARK.decode("latin-1"))
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def read_records(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """One row for each record: file, offset, shard, doc_id, start_in_shard, n_tokens, ids_crc32[, ids].

    Every checksum is verified; :class:`CorruptRecord` names the byte otherwise.
    A folder without records gives no rows.
    """
    common.prepare(spark)
    schema = "file string, offset long, shard long, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for at, payload in frames(content.as_buffer()):
                    shard, before, doc, ids = decode_record(payload)
                    rows.append((file, at, shard, doc, before, len(ids), zlib.crc32(ids), ids if with_ids else None))
                    if len(rows) == common.BATCH_ROWS:
                        yield _rows(rows, with_ids)
                        rows = []
                if rows:
                    yield _rows(rows, with_ids)

    return common.map_arrow(_files(spark, path).select("path", "content"), run, schema + ", ids array<int>" * with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    file, at, shard, doc, before, n, crc, ids = zip(*rows)
    out = dict(
        file=pa.array(file, pa.string()),
        offset=pa.array(at, pa.int64()),
        shard=pa.array(shard, pa.int64()),
        doc_id=pa.array(doc, pa.int64()),
        start_in_shard=pa.array(before, pa.int64()),
        n_tokens=pa.array(n, pa.int64()),
        ids_crc32=pa.array(crc, pa.int64()),
    )
    if with_ids:
        out["ids"] = pa.array([i.astype("int32") for i in ids], pa.list_(pa.int32()))
    return common.record_batch(**out)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Scan the files once and write the offset index beside them, as Parquet.

    ``start`` counts the ids of all records before: those before it in its
    shard, and the sums of the shards before, which are added up in two steps
    so that no task sees more than some thousand shards' numbers.
    """
    own = common.stage(read_records(spark, path, with_ids=False), "index")
    totals = own.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("run", F.expr("shard div 1024"))
    runs = totals.groupBy("run").agg(F.sum("n").alias("run_n"))
    ahead = lambda c, *by: F.coalesce(
        F.sum(c).over(W.partitionBy(*by[1:]).orderBy(by[0]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    runs = runs.select("run", ahead("run_n", "run").alias("run_start"))
    shards = totals.join(runs, "run").select(
        "shard", (F.col("run_start") + ahead("n", "shard", "run")).alias("shard_start")
    )
    index = own.join(shards, "shard").withColumn("start", F.col("shard_start") + F.col("start_in_shard"))
    index.drop("shard_start", "start_in_shard").write.parquet(index_path)
    return spark.read.parquet(index_path)


def read_by_index(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records at ``wanted``'s (file, offset) rows of the index, in any order: doc_id, ids.

    Each file that holds a wanted record is read once; its content isn't shuffled
    unless Spark finds the list of offsets too large to send along.
    """
    common.prepare(spark)
    offsets = wanted.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    files = _files(spark, path).select(F.col("path").alias("file"), "content")

    def run(batches):
        for batch in batches:
            docs, ids = [], []
            for content, at in zip(batch.column(0), batch.column(1).to_pylist()):
                view = memoryview(content.as_buffer())
                for o in at:
                    (length,) = struct.unpack_from("<Q", view, o)
                    for _, payload in frames(view[o : o + 16 + length]):
                        _, _, doc, own = decode_record(payload)
                        docs.append(doc)
                        ids.append(own.astype("int32"))
            yield common.record_batch(
                doc_id=pa.array(docs, pa.int64()), ids=pa.array(ids, pa.list_(pa.int32()))
            )

    found = files.join(offsets, "file").select("content", "offsets")
    return common.map_arrow(found, run, "doc_id long, ids array<int>")
