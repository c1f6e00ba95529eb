"""Packing of tokenized documents by bounded-space online best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Pieces that one packer takes, and the bins that it holds open.
PACKER_PIECES = 1 << 16
OPEN_BINS = 512


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins.

    Bit ``f`` of ``levels`` is set while some open bin has ``f`` free places,
    so the best bin for a piece is the lowest set bit at or above its length.
    When no bin fits and none may be opened, the fullest bin closes.
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.levels = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = self.closings = 0

    def _take(self, free: int) -> int:
        own = self.bins[free]
        bin_id = own.pop()
        if not own:
            self.levels &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of that length."""
        fitting = self.levels >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.levels & -self.levels).bit_length() - 1)
                self.closings += 1
            free, bin_id = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:  # a full bin is closed
            self.bins[left].append(bin_id)
            self.levels |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free


def cut(n_tokens: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what is left over."""
    first = n_tokens % capacity or capacity
    start = 0
    length = min(first, n_tokens)
    while start < n_tokens:
        yield start, length
        start, length = start + length, capacity


def tokenized_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_sql: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document; no shuffle."""

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            doc_ids = batch.column(0)
            ids, edges = enc.encode([t or "" for t in batch.column(1).to_pylist()], end_id)
            rows: list[tuple[int, int, int, int, int]] = []
            for i, (at, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                for k, (start, length) in enumerate(cut(end - at, capacity)):
                    rows.append((i, k, start, length, zlib.crc32(ids[at + start : at + start + length])))
            columns = list(zip(*rows)) or [()] * 5
            yield common.record_batch(
                doc_id=doc_ids.take(pa.array(columns[0], pa.int32())),
                piece=pa.array(columns[1], pa.int32()),
                start=pa.array(columns[2], pa.int64()),
                length=pa.array(columns[3], pa.int64()),
                ids_crc32=pa.array(columns[4], pa.int64()),
            )

    schema = f"doc_id {id_sql}, piece int, start long, length long, ids_crc32 long"
    return common.map_arrow(docs, run, schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    capacity: int = 1024,
    open_bins: int = OPEN_BINS,
    packer_pieces: int = PACKER_PIECES,
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Tokenizing happens where the documents lie; only the pieces' numbers are
    shuffled, to packers of about ``packer_pieces`` pieces each, at random by a
    hash so that each sees the same mix of lengths.  A packer takes its pieces in
    the order of that hash, so a task that runs again packs alike, and never
    holds more than ``open_bins`` bins open, whatever their number.
    A null or empty text is a document of its end token; no documents give no
    pieces; repeated rows and documents with the same or no id are each packed.
    """
    spark = common.prepare(docs.sparkSession)
    id_sql = common.id_type(docs, doc_id)
    rows = common.stage(
        tokenized_pieces(common.only(docs, doc_id=doc_id, text=text), vocabulary, end_id, capacity, id_sql), "pieces"
    )
    packers = common.pieces(rows.count(), packer_pieces)
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32", "length")
    dealt = (
        rows.withColumn("mixed", mixed)
        .withColumn("packer", F.pmod("mixed", F.lit(packers)).cast("int"))
        .repartition(packers, "packer")
        .sortWithinPartitions("packer", "mixed", "doc_id", "piece", "ids_crc32")
        .drop("mixed")
    )

    def run(batches):
        packer, best = None, None
        for batch in batches:
            sequence, offset = [], []
            for p, n in zip(batch.column("packer").to_pylist(), batch.column("length").to_pylist()):
                if p != packer:
                    packer, best = p, BestFit(capacity, open_bins)
                bin_id, at = best.place(n)
                sequence.append((p << 40) + bin_id)
                offset.append(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return common.map_arrow(
        dealt,
        run,
        f"doc_id {id_sql}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
