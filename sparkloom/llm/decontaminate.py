"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
#: Benchmark words (each begins a window at most) searched for at once; a larger benchmark is searched in blocks.
#: A block takes some 70 bytes a word in the driver and in each worker, and 550 while it is built.
BLOCK_WORDS = 1 << 19
#: Words that one cursor of the search walks.
SEGMENT = 512

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def segments(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of overlapping stretches of texts that lie one after the other; each window is in one of them."""
    begin, n = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
    parts = -(-n // SEGMENT)
    of = np.repeat(np.arange(len(sizes)), parts)
    start = begin[of] + SEGMENT * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    return start, np.minimum(start + SEGMENT + length - 1, (begin + sizes)[of])


class WuManber:
    """Search for many patterns of one length, words (by number) being the alphabet.

    ``patterns`` has a row for each.  ``shift`` says how far the search may move
    on after it has seen a block of words; blocks that end a pattern (shift 0) lead to
    the bucket of patterns with that suffix and the same first block, and these
    are compared.  Tables are sorted arrays, and many places are searched at a time.
    """

    def __init__(self, patterns: np.ndarray, alphabet: int):
        self.patterns, self.alphabet = patterns, alphabet
        self.length = patterns.shape[1]
        self.block = min(2, self.length)
        self.far = self.length - self.block + 1
        # the least shift of a block is that of its first place here
        blocks = [self._key(patterns, end) for end in range(self.length, self.block - 1, -1)]
        self.keys, at = np.unique(np.concatenate(blocks), return_index=True)
        self.shift = (at // max(len(patterns), 1)).astype(np.int8)
        buckets = self._bucket(np.searchsorted(self.keys, blocks[0]), np.searchsorted(self.keys, blocks[-1]))
        self.order = np.argsort(buckets, kind="stable").astype(np.int32)
        self.buckets = buckets[self.order]

    def _key(self, words: np.ndarray, end: int) -> np.ndarray:
        """Numbers of the blocks that end before column ``end``."""
        last = words[:, end - 1].astype(np.int64)
        return last if self.block == 1 else words[:, end - 2].astype(np.int64) * self.alphabet + last

    @staticmethod
    def _bucket(suffix: np.ndarray, first: np.ndarray) -> np.ndarray:
        return suffix.astype(np.int64) << 32 | first

    def _known(self, text: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of the block that ends before each place of the text; -1 where no pattern has it."""
        b = text[end - 1]
        a = text[end - 2] if self.block == 2 else b
        out = np.full(len(end), -1, np.int64)
        rows = np.flatnonzero((a >= 0) & (b >= 0))
        want = b[rows].astype(np.int64) if self.block == 1 else a[rows].astype(np.int64) * self.alphabet + b[rows]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        out[rows] = np.where(self.keys[at] == want, at, -1)
        return out

    def find(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence in texts of such sizes, which lie one after the other in ``text``."""
        start, limit = segments(sizes, self.length)
        end = start + self.length
        starts, found = [], []
        while len(end):
            known = self._known(text, end)
            step = np.where(known >= 0, self.shift[known], self.far)
            here = np.flatnonzero(step == 0)
            if len(here):
                at = end[here] - self.length
                first = self._known(text, at + self.block)
                bucket = np.where(first >= 0, self._bucket(known[here], first), -1)
                low, high = np.searchsorted(self.buckets, bucket), np.searchsorted(self.buckets, bucket, "right")
                n = high - low
                which = np.repeat(np.arange(len(here)), n)
                pattern = self.order[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
                places = at[which][:, None] + np.arange(self.length)
                same = (text[places] == self.patterns[pattern]).all(1)
                starts.append(at[which][same])
                found.append(pattern[same])
            end = end + np.maximum(step, 1)
            more = end <= limit
            end, limit = end[more], limit[more]
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(starts), np.concatenate(found)


class Searcher:
    """One :class:`WuManber` for each pattern length, and the items of each pattern."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        own = [words(text) for _, text in items]
        self.numbers: dict[bytes, int] = {}
        number = lambda w: self.numbers.setdefault(w, len(self.numbers))
        sizes = np.array([len(w) for w in own], np.int64)
        text = np.fromiter(map(number, chain.from_iterable(own)), np.int32, int(sizes.sum()))
        del own
        begin = np.cumsum(sizes) - sizes
        self.by_length: list[tuple[WuManber, np.ndarray, np.ndarray]] = []
        for n in sorted({min(int(s), window) for s in sizes if s}):
            of = np.flatnonzero(np.minimum(sizes, window) == n)
            # all runs of ``window`` words; a shorter item is one run
            each = sizes[of] - n + 1
            item = np.repeat(of, each)
            start = np.repeat(begin[of], each) + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
            runs = np.ascontiguousarray(text[start[:, None] + np.arange(n)])
            order = np.lexsort(runs.T[::-1])
            runs, item = runs[order], item[order].astype(np.int32)
            new = np.concatenate([[True], (runs[1:] != runs[:-1]).any(1)])
            self.by_length.append((WuManber(runs[new], len(self.numbers) + 1), np.flatnonzero(np.append(new, True)), item))

    def scan(self, texts: list[list[bytes]]) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """By text: word spans of all occurrences, and the items with an id that they belong to."""
        sizes = np.array([len(t) for t in texts], np.int64)
        text = np.fromiter(map(self.numbers.get, chain.from_iterable(texts), repeat(-1)), np.int32, int(sizes.sum()))
        spans: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, set[str]] = {}
        ends = np.cumsum(sizes)
        for searcher, first, item in self.by_length:
            starts, patterns = searcher.find(text, sizes)
            of = np.searchsorted(ends, starts, "right")
            begin = starts - (ends - sizes)[of]
            for i, at, p in zip(of.tolist(), begin.tolist(), patterns.tolist()):
                spans.setdefault(i, []).append((at, at + searcher.length))
                names = (self.names[k] for k in item[first[p] : first[p + 1]].tolist())
                found.setdefault(i, set()).update(n for n in names if n is not None)
        return spans, found


def covered(spans: list[tuple[int, int]]) -> int:
    """Number of words in the union of the spans."""
    total = last = 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, last))
        last = max(last, end)
    return total


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[int, Iterator[list[tuple[str | None, bytes | None]]]]:
    """How many blocks, and the benchmark's items, about ``block_words`` words at a time; a longer item is a block of its own."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9]+|[^\\x00-\\x7F]+"))
    n = common.pieces(benchmark.agg(F.sum(size)).first()[0] or 0, block_words)
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))

    def items(k: int) -> list[tuple[str | None, bytes | None]]:
        rows = (benchmark.filter(bucket == k) if n > 1 else benchmark).collect()
        return [(None if r.item_id is None else str(r.item_id), None if r.text is None else r.text.encode()) for r in rows]

    return n, map(items, range(n))


_COUNTS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    prefix: str = "",
) -> DataFrame:
    """All columns of ``docs`` and what was found in each text.

    Added: ``n_words``, ``n_hit`` (words inside an occurrence of a window),
    ``n_items``, ``items_sha256`` (of the sorted ids joined by commas) and
    ``contaminated``, each behind ``prefix``; an existing column of such a name
    is replaced.  Documents stay where they are: the patterns go to them, about
    ``block_words`` of the benchmark's words at a time.  If there are more, the
    documents are written once and each further block adds what it finds, by row.
    A null text has no words; a null benchmark text has no windows; an item without an id marks
    words but isn't counted or listed; an empty benchmark marks nothing.
    Repeated rows are each reported.
    """
    spark = common.prepare(docs.sparkSession)
    items = common.only(benchmark, item_id=item_id, text=item_text)
    added = [f"{prefix}{c.split()[0]}" for c in _COUNTS.split(", ")]
    docs = docs.drop(*added)
    # the columns pass by under names of ours, so that they can't clash
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text)
    spans_and_items = [T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    held = T.StructType([*own.schema.fields, T.StructField("words", T.LongType()), *spans_and_items])
    done = T.StructType(
        [
            *docs.schema.fields,
            *[T.StructField(a, T._parse_datatype_string(c.split()[1])) for a, c in zip(added, _COUNTS.split(", "))],
        ]
    )

    def search(texts: pa.Array, searcher: Searcher) -> tuple[list[int], pa.Array, pa.Array]:
        split = [words(t) for t in common.text_bytes(texts)]
        spans, found = searcher.scan(split)
        flat = [[x for s in spans.get(i, ()) for x in s] for i in range(len(split))]
        names = [sorted(found.get(i, ())) for i in range(len(split))]
        return [len(w) for w in split], pa.array(flat, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))

    def first_search(shared):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, spans, names = search(batch.column(at), shared.value)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), spans, names], names=held.names)

        return run

    def more_search(shared):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, spans, names = search(batch.column(1), shared.value)
            return common.record_batch(row=batch.column(0), spans=spans, items=names)

        return run

    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        *columns, sizes, spans, names = batch.columns
        hit = [covered(list(zip(f[::2], f[1::2]))) for f in spans.to_pylist()]
        own = [sorted(set(n)) for n in names.to_pylist()]
        columns += [
            sizes,
            pa.array(hit, pa.int64()),
            pa.array([len(i) for i in own], pa.int64()),
            pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in own], pa.string()),
            pa.array([h > 0 for h in hit], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=done.names)

    n_blocks, blocks = _blocks(items, block_words)
    search_first = first_search(spark.sparkContext.broadcast(Searcher(next(blocks), window)))
    if n_blocks == 1:  # in one step: each step of Python's in a task has a worker of its own, which keeps its memory
        return common.map_batches(own, lambda batch: summed(search_first(batch)), done)
    found = common.map_batches(own, search_first, held)
    further: DataFrame | None = None
    for block in blocks:
        if further is None:
            found = common.stage(found.withColumn("row", F.monotonically_increasing_id()), "searched")
        searcher = spark.sparkContext.broadcast(Searcher(block, window))
        some = common.map_batches(
            found.select("row", f"c{at}"), more_search(searcher), T.StructType([T.StructField("row", T.LongType()), *spans_and_items])
        )
        some = common.stage(some.filter(F.size("spans") > 0), "found")
        searcher.destroy()
        further = some if further is None else further.union(some)
    if further is not None:
        both = lambda c: F.flatten(F.collect_list(c)).alias(f"more_{c}")
        further = further.groupBy("row").agg(both("spans"), both("items"))
        joined = lambda c: F.concat(c, F.coalesce(f"more_{c}", F.array().cast(held[c].dataType))).alias(c)
        found = found.join(further, "row", "left").select(*own.columns, "words", joined("spans"), joined("items"))
    return common.map_batches(found, summed, done)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark window, with their columns unchanged."""
    prefix = common.free_prefix(docs, "__bench_")
    found = decontaminate(docs, benchmark, prefix=prefix, **options)
    return found.filter(~F.col(f"{prefix}contaminated")).select(*[f"`{c}`" for c in docs.columns])
