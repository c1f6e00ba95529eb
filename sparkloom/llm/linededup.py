"""Line dedup through a sharded minimal perfect hash of the lines that recur."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_CHARS = 10
#: Recurring lines of one shard of the index, and lines that one task looks up in it.
SHARD_LINES = 1 << 17
PROBE_LINES = 1 << 18

_WHITE = common.WHITE.encode()


def key_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line's key; None where the key is too short."""
    key = line.strip(_WHITE).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


class MinimalPerfectHash:
    """Keys (two words of 64 bits) to 0 .. n-1, each its own number; others to a wrong one or -1.

    Level by level, each key takes a bit of an array of twice the keys; keys
    alone on their bit are done, the others go on to the next level.  A key's
    number is the count of set bits before its own.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.levels: list[np.ndarray] = []
        a, b = np.asarray(first, np.uint64), np.asarray(second, np.uint64)
        while len(a):
            size = max(64, -(-2 * len(a) // 64) * 64)
            spot = self._spot(a, b, len(self.levels), size)
            used = np.bincount(spot, minlength=size)
            self.levels.append(used == 1)
            more = used[spot] != 1
            a, b = a[more], b[more]
            if len(self.levels) > 200:
                raise ValueError("keys repeat")
        self._rank()

    def _rank(self) -> None:
        self.ranks, base = [], 0
        for bits in self.levels:
            rank = np.cumsum(bits, dtype=np.int64) - bits + base
            self.ranks.append(rank.astype(np.int32))
            base += int(bits.sum())
        self.n = base

    @staticmethod
    def _spot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        # both words, so that keys that share one part sooner or later
        x = a + b * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.full(len(first), -1, np.int64)
        left = np.arange(len(first))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            spot = self._spot(first[left], second[left], level, len(bits))
            hit = bits[spot]
            out[left[hit]] = ranks[spot[hit]]
            left = left[~hit]
        return out

    def packed(self) -> list[bytes]:
        return [np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> "MinimalPerfectHash":
        self = cls.__new__(cls)
        self.levels = [np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for b in levels]
        self._rank()
        return self


@dataclass
class Shard:
    """Arrays behind the perfect hash: fingerprint, rows with the line, the smallest document with it."""

    places: MinimalPerfectHash
    prints: np.ndarray
    counts: np.ndarray
    owners: np.ndarray

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is the line here, its smallest document) of each key."""
        at = self.places(first, second)
        known = at >= 0
        at = np.where(known, at, 0)
        return known & (self.prints[at] == (first ^ second)) & (self.counts[at] >= 2), self.owners[at]


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(row, line, doc_id, place, print, new) of every key in (row, doc_id, text); ``new``: the row's first with that key."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, lines, digests, new = [], [], [], []
        for i, text in enumerate(common.text_bytes(batch.column(2))):
            seen = set()
            for j, line in enumerate((text or b"").split(b"\n")):
                h = key_hash(line, min_chars)
                if h:
                    rows.append(i)
                    lines.append(j)
                    digests.append(h)
                    new.append(h not in seen)
                    seen.add(h)
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        at = pa.array(rows, pa.int32())
        return common.record_batch(
            row=batch.column(0).take(at),
            line=pa.array(lines, pa.int32()),
            doc_id=batch.column(1).take(at),
            place=pa.array(both[:, 0], pa.int64()),
            print=pa.array(both[:, 1], pa.int64()),
            new=pa.array(new, pa.bool_()),
        )

    return common.map_batches(docs, run, "row long, line int, doc_id long, place long, print long, new boolean")


def build_index(lines: DataFrame, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int, int]:
    """The index of lines in two documents or more: (a row of arrays for each shard, shards, lines).

    Counts and owners come from all documents by a map-side aggregate; a hot
    line is one row of each task.  Lines in one document only are no use to
    the documents that probe, so they get no place in the arrays.
    """
    found = lines.groupBy("place", "print").agg(
        F.sum(F.col("new").cast("long")).alias("n"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")
    )
    # the same document may come in several rows: two documents are two ids
    again = common.stage(found.filter("owner <> last").drop("last"), "lines")
    n = again.count()
    shards = common.pieces(n, shard_lines)

    def build(table: pa.Table) -> pa.Table:
        first, second = (table[c].to_numpy().view(np.uint64) for c in ("place", "print"))
        places = MinimalPerfectHash(first, second)
        order = np.empty(len(first), np.int64)
        order[places(first, second)] = np.arange(len(first))
        counts, owners = table["n"].to_numpy()[order].astype("<i4"), table["owner"].to_numpy()[order].astype("<i8")
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
                "levels": pa.array([places.packed()], pa.list_(pa.binary())),
                "prints": pa.array([(first ^ second)[order].tobytes()], pa.binary()),
                "counts": pa.array([counts.tobytes()], pa.binary()),
                "owners": pa.array([owners.tobytes()], pa.binary()),
            }
        )

    rows = (
        again.withColumn("n", F.least("n", F.lit(2**31 - 1)))
        .withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(build, "shard int, levels array<binary>, prints binary, counts binary, owners binary")
    )
    return common.stage(rows, "index"), shards, n


def _load(table: pa.Table) -> Shard:
    row = table.slice(0, 1).to_pylist()[0]
    return Shard(
        MinimalPerfectHash.unpacked(row["levels"]),
        np.frombuffer(row["prints"], "<u8"),
        np.frombuffer(row["counts"], "<i4"),
        np.frombuffer(row["owners"], "<i8"),
    )


def lines_to_drop(lines: DataFrame, index: DataFrame, shards: int, probe_lines: int = PROBE_LINES) -> DataFrame:
    """(row, line) of the lines that another, smaller document has.

    Lines go to their shard as numbers; a shard's lines are dealt to as many
    tasks as they need, each with the shard's arrays, so neither a hot line nor
    the index's size makes a task large.
    """
    own = lines.select("row", "line", "doc_id", "place", "print", F.pmod("place", F.lit(shards)).cast("int").alias("shard"))
    counted = own.groupBy("shard").agg(F.count("*").alias("n"))
    deals = common.stage(counted.select("shard", F.ceil(F.col("n") / probe_lines).cast("int").alias("tasks")), "deals")
    # as many rows as shards
    dealt = own.join(F.broadcast(deals) if shards <= 100_000 else deals, "shard").withColumn(
        "task", F.pmod(F.xxhash64("row", "line"), F.col("tasks")).cast("int")
    )
    held = index.join(deals, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")

    def probe(arrays: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(arrays) or not len(asking):
            return pa.table({"row": pa.array([], pa.int64()), "line": pa.array([], pa.int32())})
        first, second = (asking[c].to_numpy().view(np.uint64) for c in ("place", "print"))
        known, owners = _load(arrays).find(first, second)
        ids = asking["doc_id"].combine_chunks()
        mine = np.asarray(ids.is_valid()) & (ids.fill_null(0).to_numpy(zero_copy_only=False) == owners)
        gone = known & ~mine
        return pa.table({"row": asking["row"].filter(pa.array(gone)), "line": asking["line"].filter(pa.array(gone))})

    return held.groupBy("shard", "task").cogroup(dealt.drop("tasks").groupBy("shard", "task")).applyInArrow(probe, "row long, line int")


def dedup_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    shard_lines: int = SHARD_LINES,
    probe_lines: int = PROBE_LINES,
    prefix: str = "",
) -> DataFrame:
    """All columns of ``docs`` with the lines kept as text, and what was dropped.

    Keys of at least ``min_chars`` code points in two documents or more lose all
    their lines but for those in the smallest ``doc_id`` with the key.  Added,
    behind ``prefix``: ``n_lines`` (before), ``n_dropped``, ``kept_sha256``.
    Documents are written once with a row number; from then on only numbers are
    shuffled, until the lines to drop meet their documents.

    A null or empty text is one empty line; its text becomes empty.  A document
    without an id doesn't count as one of the two and loses what two others share.  Rows that
    repeat an id are one document.  Ids are long integers: other numbers are cast,
    and an id that can't be is an error.  No documents give no rows.
    """
    common.prepare(docs.sparkSession)
    added = [f"{prefix}{c}" for c in ("n_lines", "n_dropped", "kept_sha256")]
    docs = docs.drop(*added)
    # the columns pass by under names of ours, so that they can't clash
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at_id, at_text = docs.columns.index(doc_id), docs.columns.index(text)
    own = common.stage(own.withColumn("row", F.monotonically_increasing_id()), "documents")
    numbered = own.select("row", F.col(f"c{at_id}").cast("long"), f"c{at_text}")
    lines = common.stage(line_hashes(numbered, min_chars), "hashes")
    index, shards, _ = build_index(lines, shard_lines)
    drops = lines_to_drop(lines, index, shards, probe_lines).groupBy("row").agg(F.collect_list("line").alias("drops"))
    whole = own.join(drops, "row", "left").drop("row")
    done = T.StructType(
        [
            *docs.schema.fields,
            *[T.StructField(a, t) for a, t in zip(added, (T.LongType(), T.LongType(), T.StringType()))],
        ]
    )

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        *columns, gone = batch.columns
        sizes, dropped, kept = [], [], []
        for t, g in zip(common.text_bytes(columns[at_text]), gone.to_pylist()):
            lines, out = (t or b"").split(b"\n"), set(g or ())
            sizes.append(len(lines))
            dropped.append(len(out))
            kept.append(b"\n".join([x for j, x in enumerate(lines) if j not in out]) if out else t or b"")
        kind = columns[at_text].type
        columns[at_text] = pa.array(kept, pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).cast(kind)
        columns += [
            pa.array(sizes, pa.int64()),
            pa.array(dropped, pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=done.names)

    return common.map_batches(whole, drop, done)


def keep_lines(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The documents with the lines kept; other columns unchanged but for ``n_chars``, if there is one."""
    found = dedup_lines(docs, text=text, prefix=common.free_prefix(docs, "__lines_"), **options)
    if n_chars in docs.columns:
        found = found.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return found.select(*[f"`{c}`" for c in docs.columns])
