"""Importance resampling towards a target distribution of hashed n-grams, in two Arrow passes.

The first pass counts features into one vector of buckets for each partition,
which a tree of reductions adds up; the second weighs every document by the
buckets' gains.  Nothing but vectors of fixed length and a row of numbers for
each document leaves the tasks that read the texts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SALT = 42

#: Bytes of text that are cut into words at a time; a longer text goes in several steps.
STEP_BYTES = 1 << 20
#: Words longer than this get their checksum from zlib, one by one.
TABLE_BYTES = 48

#: Byte by byte: A-Z to a-z, the rest as it is.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and whatever belongs to a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _byte_table() -> np.ndarray:
    """CRC-32 of one byte's remainder, by the polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum becomes when n bytes follow; a checksum is linear in these."""
    one = np.arange(256, dtype=np.uint32)
    rows = [np.stack([one << np.uint32(8 * k) for k in range(4)])]
    for _ in range(TABLE_BYTES + 1):
        rows.append(_BYTE[rows[-1] & 0xFF] ^ (rows[-1] >> np.uint32(8)))
    return np.stack(rows)


_SHIFT = _shift_tables()


def _shift(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The checksums' part in that of a text that goes on for ``lengths`` bytes."""
    out = np.zeros(len(sums), np.uint32)
    at = np.minimum(lengths, TABLE_BYTES + 1)
    for k in range(4):
        out ^= _SHIFT[at, k, (sums >> np.uint32(8 * k)) & 0xFF]
    far = lengths - at
    for i in np.flatnonzero(far):  # very long words
        value = int(out[i])
        zeros = bytes(min(int(far[i]), 1 << 20))
        left = int(far[i])
        while left:
            n = min(left, len(zeros))
            # appending zero bytes to a raw remainder: undo zlib's start and end values
            value = zlib.crc32(zeros[:n], value ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            left -= n
        out[i] = value
    return out


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all words a byte further at a time."""
    lengths = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(lengths, TABLE_BYTES + 1), kind="stable")
    at, size = starts[order], lengths[order]
    state = out[order]
    left = np.searchsorted(-size, -np.arange(1, TABLE_BYTES + 1), side="right")
    for k in range(TABLE_BYTES):
        n = left[k]
        if not n:
            break
        state[:n] = _BYTE[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    for i in np.flatnonzero(lengths > TABLE_BYTES):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def features(offsets: np.ndarray, data: np.ndarray, longest: int = LONGEST, step: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """(texts, checksums, words) of the n-grams of 1 to ``longest`` words, a stretch of the texts at a time.

    ``words`` are the texts of the stretch's words.  A checksum of several words comes
    from theirs: that of the front is carried over the bytes that follow.
    A stretch ends where a word does; its last words are kept for the next one's n-grams.
    """
    texts, sums, spaced, sizes = [np.zeros(0, t) for t in (np.int64, np.uint32, np.uint32, np.int64)]
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + step, end)
        while hi < end and _WORD[data[hi]]:  # to the end of the word
            more = _WORD[data[hi : hi + step]]
            hi += len(more) if more.all() else int(np.argmin(more))
        part = _LOWER[data[lo:hi]]
        inside = np.zeros(len(part) + 1, bool)
        inside[:-1] = _WORD[part]
        edges = offsets[(offsets > lo) & (offsets < hi)] - lo
        first = np.empty(len(part), bool)
        first[0], first[1:] = inside[0], inside[1:-1] & ~inside[:-2]
        first[edges] = inside[edges]
        last = inside[:-1] & ~inside[1:]
        last[edges - 1] |= inside[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        own = np.searchsorted(offsets, starts + lo, side="right") - 1
        got = _checksums(part, starts, ends)
        size = ends - starts
        space = np.full(len(got), zlib.crc32(b" "), np.uint32)
        texts, sums, sizes = np.concatenate([texts, own]), np.concatenate([sums, got]), np.concatenate([sizes, size])
        spaced = np.concatenate([spaced, _shift(space, size) ^ got])
        new = len(texts) - len(own)
        yield own, got, own
        run, at = sums, np.arange(len(sums))
        for n in range(2, longest + 1):
            # run[i]: n - 1 words from word i on
            follow = at[: len(run) - 1] + n - 1
            follow = follow[follow < len(sums)]
            run = _shift(run[: len(follow)], sizes[follow] + 1) ^ spaced[follow]
            whole = (texts[: len(follow)] == texts[follow]) & (follow >= new)
            yield texts[: len(follow)][whole], run[whole], own[:0]
        keep = slice(max(0, len(texts) - longest + 1), None)
        texts, sums, spaced, sizes = texts[keep], sums[keep], spaced[keep], sizes[keep]
        lo = hi


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def count_features(docs: DataFrame, *, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket: a vector for each partition, added up by a tree of tasks."""
    spark = common.prepare(docs.sparkSession)

    def run(batches):
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, sums, _ in features(*_buffers(batch.column(0)), longest):
                found += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        yield common.record_batch(counts=pa.array([found.tobytes()], pa.binary()))

    vectors = common.only(docs, text=text).mapInArrow(run, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    none = spark.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return vectors.union(none).treeReduce(np.add, depth=max(2, math.ceil(math.log(1 + vectors.getNumPartitions(), 64))))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum()) + n, float(target.sum()) + n
    ratio = (target + 1.0) * s_all / ((corpus + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id, salt: int = SALT) -> int:
    """A Gumbel number in thousandths, fixed by the id; a document without an id has that of an empty one."""
    h = int(hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, *, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, salt: int = SALT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document; no shuffle."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(gain)
    id_sql = common.id_type(docs, doc_id)

    def run(batches):
        table = shared.value
        for batch in batches:
            n = batch.num_rows
            words, found = np.zeros(n, np.int64), np.zeros(n, np.int64)
            weight = np.zeros(n)
            for texts, sums, own in features(*_buffers(batch.column(1)), longest):
                words += np.bincount(own, minlength=n)
                found += np.bincount(texts, minlength=n)
                # sums of whole numbers below 2^53 are exact in doubles
                weight += np.bincount(texts, weights=table[sums % np.uint32(len(table))], minlength=n)
            ids = batch.column(0)
            weight = weight.astype(np.int64)
            yield common.record_batch(
                doc_id=ids,
                n_words=pa.array(words),
                n_features=pa.array(found),
                weight=pa.array(weight),
                score=pa.array(weight + np.array([noise(i, salt) for i in ids.to_pylist()], np.int64)),
            )

    schema = f"doc_id {id_sql}, n_words long, n_features long, weight long, score long"
    return common.map_arrow(common.only(docs, doc_id=doc_id, text=text), run, schema)


def _ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rank`` by falling score and rising id for the first ``drawn`` rows, null for others.

    Rows are numbers, dealt to range partitions of equal size; equal ones are
    told apart by their place, so that a score shared by very many is split.
    """
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("place")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    ranged = common.stage(placed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "scores")
    # a row for each partition
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    at = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order))
    return ranged.join(F.broadcast(before), "part").withColumn("rank", F.when(at <= drawn, at)).drop("place", "part", "before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    salt: int = SALT,
) -> DataFrame:
    """Every document with the log-weight of its features and, if drawn, its rank.

    Returns doc_id, n_words, n_features, weight, score and rank; the
    ``percent`` of the documents of ``min_words`` words or more with the highest
    scores (weight and Gumbel noise) are drawn, so that the drawing is one
    without replacement in proportion to the weights.  Ties go to the smaller
    id.  Null, empty and wordless texts have no features, weight 0 and no rank.
    A document without an id has the noise of an empty id and loses ties; rows
    that share an id, repeated rows included, are each scored and may each be
    drawn.  Texts are read whole, a long one in steps.  No documents give none;
    an empty target weighs each bucket by the corpus alone.  Other columns are
    left out, whatever their names.
    """
    gain = gains(count_features(docs, text=text, buckets=buckets, longest=longest), count_features(target, text=target_text, buckets=buckets, longest=longest))
    rows = common.stage(weigh(docs, gain, doc_id=doc_id, text=text, longest=longest, salt=salt), "weights")
    able = F.col("n_words") >= min_words
    drawn = percent * rows.filter(able).count() // 100
    left = rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return _ranked(rows.filter(able), drawn).unionByName(left)
