"""Language-model scores from a probabilistic suffix tree over words.

The tree's states are contexts of up to ``max_depth`` words.  Its root is the
add-one-half unigram distribution.  A context is a candidate if it occurs
``min_context`` times in training, and a next word is kept apart in its
distribution if it follows ``min_entry`` times; all other next words of a state
share what is left in proportion to the parent's distribution.  A state is
retained if its distribution diverges from its parent's by more than half the
number of its entries times the logarithm of its count, or if a longer state
that ends in it is.  The minimum counts are the same for every corpus, so what is
put to the test in a corpus is put to it in a larger one too, and the tree grows with the corpus.

The tree is never gathered: it is built level by level as tables, by joins.  Since
a state's probability of a word is its parent's times a factor, the logarithm of
a text's probability is a sum over its n-grams: each n-gram has a value (what it
adds as a state that the next token is read in, and as a known next word of a
state), and texts meet these values where both are shuffled by ranges of keys, in
blocks; a task adds up what its documents' n-grams meet.  Broadcasts of a bounded size
save rows and change no result: bit maps of n-grams, and the values of the most
frequent ones.  So that disk stays a small multiple of the input, a level with many
n-grams is counted in parts, by ranges of contexts, documents are scored in parts,
these meet the values in parts by ranges of keys, and what a part has shuffled or
staged goes before the next.

Hashes of 64 bits stand for words and n-grams: two that share one share a count.
An n-gram's key is made from the keys of the n-grams without its last
and without its first word.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Occurrences from which a context and, in it, a next word are put to the test of divergence, whatever the corpus's size.
MIN_CONTEXT, MIN_ENTRY = 128, 4
MAX_DEPTH = 4
FOLDS, HELD_OUT = 5, 1
#: The end token's stand-in; no UTF-8 text holds this byte.
END = b"\xff"
#: A map of n-grams has some sixteen bits for each, but no more than 2^27 (16 MB).
MAP_BITS = 27
#: The values of so many n-grams at most, the most frequent ones, go to all tasks, at 24 bytes each.
FREQUENT = 1 << 20
#: N-grams that are shuffled at once, as a share of the training tokens: while a level is counted, before equal ones
#: are put together (texts are scored so many n-grams at once, too), and while these meet the values that didn't go to all tasks.
COUNTED, MET = 0.25, 0.0625
#: So many are always shuffled at once.
AT_ONCE = 2_000_000
#: N-grams that a task puts together at a time; they are shuffled in blocks, a block for each of so many buckets a task, and this many buckets at least.
GATHERED, BUCKETS, LEAST_BUCKETS = 1 << 20, 16, 1024
_FLUSH = 2_000_000
#: Bytes of text that are hashed at once; words of more than so many bytes are hashed alone.
_CHUNK, _LONG = 1 << 20, 256


def is_held_out(doc_id: object, folds: int = FOLDS, fold: int = HELD_OUT) -> bool:
    """By the crc32 of the id as text; a document without an id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = bytes(32 if b in common.WHITE.encode() else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, _CHUNK + 1)
            self.up, self.down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a lower-cased text whose only white space is the space.

    A word's hash is a polynomial of its bytes, which comes for all words at once
    from running sums; long words, for which such polynomials are weak, have XXH3.
    """
    out, at = [], 0
    while at < len(text):
        end = at + _CHUNK
        if end < len(text):
            space = text.rfind(b" ", at, end)
            if space < 0:
                space = text.find(b" ", end)
            end = len(text) if space < 0 else space + 1
        data = np.frombuffer(text, np.uint8, min(end, len(text)) - at, at)
        edges = np.flatnonzero(np.diff((data != 32).astype(np.int8), prepend=0, append=0))
        start, stop = edges[::2], edges[1::2]
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        x = (sums[stop] - sums[start]) * down[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        for i in np.flatnonzero(stop - start > _LONG).tolist():
            x[i] = xxhash.xxh3_64_intdigest(text[at + start[i] : at + stop[i]])
        out.append(x)
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_END_KEY = word_hashes(END)[0]


def word_keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all tokens, number of tokens of each text); each text's last token is the end."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    between = b" " + END + b" "
    keys = word_hashes((between.join([t or b"" for t in texts]) + between).translate(_LOWER))
    ends = np.flatnonzero(keys == _END_KEY)
    return keys, np.diff(ends, prepend=-1)


def places(sizes: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def mix(without_last: np.ndarray, without_first: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the keys of the two n-grams one word shorter."""
    x = without_last * np.uint64(0x9E3779B97F4A7C15) + without_first * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def longer(keys: np.ndarray) -> np.ndarray:
    """Keys of the n-grams one word longer that end where these do; the first has none."""
    out = np.zeros_like(keys)
    out[1:] = mix(keys[:-1], keys[1:])
    return out


def unigrams(docs: DataFrame) -> DataFrame:
    """(h, c): hash and count of every training token."""

    def rows(keys: list[np.ndarray]):
        k, c = np.unique(np.concatenate(keys), return_counts=True)
        for i in range(0, len(k), 1 << 16):
            j = i + (1 << 16)
            yield common.record_batch(h=pa.array(k[i:j].view("<i8"), pa.int64()), c=pa.array(c[i:j].astype(np.int64), pa.int64()))

    def run(batches):
        keys, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys.append(word_keys([t for d, t in zip(ids, common.text_bytes(batch.column(1))) if not is_held_out(d)])[0])
            size += len(keys[-1])
            if size > _FLUSH:
                yield from rows(keys)
                keys, size = [], 0
        if size:
            yield from rows(keys)

    return common.map_arrow(docs, run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


# ------------------------------------------------------------------ bit maps and frequent values


def bit_map(keys: DataFrame, most: int = MAP_BITS) -> np.ndarray:
    """A map with each key's bit set, of 2^``most`` bits at most; keys that share a bit can't be told apart by it."""
    bits = min(max((16 * keys.count()).bit_length(), 15), most)
    place = F.pmod("key", F.lit(1 << bits)) + 1
    rows = (
        keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("map"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for bucket, own in zip(rows["bucket"].to_pylist(), rows["map"].to_pylist()):
        at = (bucket - 1) * len(own)
        out[at : at + len(own)] = np.frombuffer(own, np.uint8)[: len(out) - at]
    return out


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Lookup:
    """Numbers of sorted keys; their first 16 bits say where to look."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # sorted, unsigned
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        heads = (keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange((1 << int(64 - int(self.shift))) + 1))

    def __reduce__(self):  # every executor and the driver have a broadcast on disk
        return Lookup, (self.keys,)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        head = (keys >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            same = self.keys[at[left]] == keys[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


# ------------------------------------------------------------------ the tree


def count_entries(docs: DataFrame, depth: int, shared: Broadcast, part: int = 0, parts: int = 1) -> DataFrame:
    """(pre, suf, c, key): training counts of (depth + 1)-grams by the keys without the last and without the first word.

    Only those are counted whose ``pre`` is in the first map of ``shared`` (contexts)
    and whose ``suf`` is in the second (frequent n-grams): others can't be frequent.  Of ``parts``
    ranges of contexts, only that of number ``part`` is counted.  ``shared`` also has the least
    count that is returned and how many tasks put the counts of the texts' tasks together.

    What is shuffled are blocks of n-grams, in which a context stands once for all words that follow.  A
    context's next words are dealt to sixteen buckets, so that a frequent context is no single task's.
    """
    tasks = shared.value[3]
    buckets = min(max(BUCKETS * tasks, LEAST_BUCKETS), 1 << 16)

    def blocks(pre: list[np.ndarray], suf: list[np.ndarray]):
        a, b = np.concatenate(pre), np.concatenate(suf)
        if not len(a):
            return
        bucket = ((a >> np.uint64(24)) + (b & np.uint64(15))) % np.uint64(buckets)
        # equal pairs come together and pairs of one context stay near
        low = np.uint64((1 << 24) - 1)
        order = np.argsort((bucket << np.uint64(48)) | ((a & low) << np.uint64(24)) | (mix(a, b) & low))
        a, b, bucket = a[order], b[order], bucket[order]
        edge = np.flatnonzero(_changes(a, b))
        n = np.diff([*edge, len(a)])
        a, b, bucket = a[edge], b[edge], bucket[edge]
        run = np.flatnonzero(_changes(a, bucket))
        long = np.diff([*run, len(a)])
        first = np.flatnonzero(_changes(bucket))
        at, runs = np.append(first, len(a)), np.append(np.searchsorted(run, first), len(run))
        yield from _small(
            np.diff(at),
            bucket=pa.array(bucket[first].astype(np.int32), pa.int32()),
            pre=_packed(a[run], runs),
            long=_packed(long.astype("<u4"), runs),
            suf=_packed(b, at),
            c=_packed(n.astype("<u4"), at),
        )

    def run(batches):
        contexts, words = shared.value[:2]
        pre, suf, size = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t for d, t in zip(ids, common.text_bytes(batch.column(1))) if not is_held_out(d)]
            keys, sizes = word_keys(texts)
            place = places(sizes)
            for _ in range(depth - 1):
                keys = longer(keys)
            good = place[1:] >= depth
            if parts > 1:
                good &= (keys[:-1] >> np.uint64(40)) % np.uint64(parts) == part
            at = np.flatnonzero(good)
            good = at[in_map(contexts, keys[at])]
            good = good[in_map(words, keys[good + 1])]
            pre.append(keys[good])
            suf.append(keys[good + 1])
            size += len(pre[-1])
            if size > _FLUSH:
                yield from blocks(pre, suf)
                pre, suf, size = [], [], 0
        if size:
            yield from blocks(pre, suf)

    def gather(batches):
        least, got, size, known = shared.value[2], [], 0, 0
        for batch in batches:
            _, pre, long, suf, c = map(_column, batch.columns, ("<i4", "<u8", "<u4", "<u8", "<u4"))
            got.append((np.repeat(pre, long), suf, c.astype(np.int64)))
            size += len(c)
            if size > known + 2 * GATHERED:  # equal ones are put together before there are many
                got = [_added(got)]
                size = known = len(got[0][0])
        if not got:
            return
        a, b, c = _added(got)
        a, b, c = (x[c >= least] for x in (a, b, c))
        for i in range(0, len(a), 1 << 16):
            pre, suf, n = (x[i : i + (1 << 16)] for x in (a, b, c))
            yield common.record_batch(pre=_longs(pre), suf=_longs(suf), c=pa.array(n, pa.int64()), key=_longs(mix(pre, suf)))

    found = common.map_arrow(docs, run, "bucket int, pre binary, long binary, suf binary, c binary")
    return found.repartition(tasks, "bucket").mapInArrow(gather, "pre long, suf long, c long, key long")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = reduce(np.logical_or, [x[1:] != x[:-1] for x in columns])
    return out


def _added(got: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs once, with the sum of their counts."""
    a, b, c = (np.concatenate(x) for x in zip(*got))
    if not len(a):
        return a, b, c
    order = np.argsort(mix(a, b))
    a, b = a[order], b[order]
    edge = np.flatnonzero(_changes(a, b))
    return a[edge], b[edge], np.add.reduceat(c[order], edge)


def _longs(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view("<i8"), pa.int64())


def _packed(numbers: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The numbers between each two edges as the bytes of one value."""
    offsets = (edges * numbers.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def _column(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of a column of whole or packed numbers, one row after the other."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy()
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind)


def _small(sizes: np.ndarray, most: int = 1 << 16, **columns: pa.Array):
    """Batches of some ``most`` numbers, of rows with so many each."""
    whole = common.record_batch(**columns)
    group = (np.cumsum(sizes) - sizes) // most
    edges = [*np.flatnonzero(_changes(group)).tolist(), len(sizes)]
    for i, j in zip(edges, edges[1:]):
        yield whole.slice(i, j - i)


def _level(entries: DataFrame, states: DataFrame, lower: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, states) of a depth with their probabilities and divergence tests.

    ``entries`` are counts (pre, suf, c, key), ``states`` candidates (key, n,
    up: the state one word shorter), ``lower`` the shorter contexts' (key, prob).
    """
    own = entries.join(states.select(F.col("key").alias("pre"), "n"), "pre").join(
        lower.select(F.col("key").alias("suf"), F.col("prob").alias("parent")), "suf"
    )
    own = common.stage(own.select("pre", "suf", "c", "key", "n", "parent"), "entries", free=True)
    tested = (
        own.groupBy("pre")
        .agg(
            F.first("n").alias("n"),
            F.sum("c").alias("kept"),
            F.sum("parent").alias("parent_kept"),
            (F.count("*") + 1).alias("classes"),
            F.sum(F.expr("c * ln(c / n / parent)")).alias("gain"),
        )
        .withColumn("left", F.col("n") - F.col("kept"))
        .withColumn("parent_rest", F.greatest(1 - F.col("parent_kept"), F.lit(1e-9)))
        .withColumn("keep", F.expr("n / (n + classes)"))
        .select(
            "pre",
            "n",
            "keep",
            F.expr("keep * left / n / parent_rest + (1 - keep)").alias("rest"),
            F.expr(
                "gain + if(left > 0, left * ln(left / n / parent_rest), 0D) > 0.5D * classes * ln(n)"
            ).alias("diverges"),
        )
    )
    tested = common.stage(tested.join(states.select(F.col("key").alias("pre"), "up"), "pre"), "states", free=True)
    probs = own.join(tested.select("pre", "keep"), "pre").select(
        "pre", "suf", "c", "key", "parent", F.expr("keep * c / n + (1 - keep) * parent").alias("prob")
    )
    probs = common.stage(probs, "probabilities", free=True)
    common.unstage(own)
    return probs, tested


@dataclass
class SuffixTree:
    """The values of n-grams (key, c: count of a single word else null, n: count, tree: log10), and how many there are."""

    values: DataFrame
    train_tokens: int
    vocabulary: int
    states: list[int]

    @property
    def log_total(self) -> float:
        """log10 of what the root divides by."""
        return float(np.log10(self.train_tokens + 0.5 * (self.vocabulary + 1)))


def train(
    docs: DataFrame, min_context: int = MIN_CONTEXT, min_entry: int = MIN_ENTRY, max_depth: int = MAX_DEPTH
) -> SuffixTree:
    """The tree of the training documents (doc_id, text); every level is counted over all of them."""
    counts = common.stage(unigrams(docs), "unigrams", free=True)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    min_context = max(min_context, min_entry)
    # a next word that is kept apart occurs as often by itself
    root = counts.filter(F.col("c") >= min_entry).select(F.col("h").alias("key"), ((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1))).alias("prob"))
    known = counts.filter(F.col("c") >= min_entry).select(F.col("h").alias("key"), "c", F.lit(None).cast("long").alias("suf"))
    levels: list[tuple[DataFrame, DataFrame]] = []
    lower = root
    for depth in range(1, max_depth + 1):
        candidates = known.filter(F.col("c") >= min_context)
        total = candidates.agg(F.sum("c")).first()[0] or 0
        parts = _parts(total, COUNTED * n)
        maps = bit_map(candidates.select("key")), bit_map(known.select("key"))
        shared = docs.sparkSession.sparkContext.broadcast((*maps, min_entry, common.pieces(total / parts, GATHERED)))
        entries = [common.stage(count_entries(docs, depth, shared, i, parts), "counts", free=True) for i in range(parts)]
        shared.destroy()
        states = candidates.select("key", F.col("c").alias("n"), F.col("suf").alias("up"))
        levels.append(_level(reduce(DataFrame.union, entries), states, lower))
        common.unstage(*entries)
        lower = known = levels[-1][0]
    # a retained state keeps its suffixes
    retained: list[DataFrame] = []
    for _, tested in reversed(levels):
        if retained:
            below = retained[0].select(F.col("up").alias("pre"), F.lit(True).alias("held")).distinct()
            tested = tested.join(below, "pre", "left").filter("diverges or held").drop("held")
        else:
            tested = tested.filter("diverges")
        retained.insert(0, common.stage(tested, "retained", free=True))
    common.unstage(*[tested for _, tested in levels])
    states = [r.count() for r in retained]
    inner = [r.select(F.col("pre").alias("key"), F.log10("rest").alias("tree"), "n") for r in retained]
    values = []
    for depth, (probs, _) in enumerate(levels, 1):  # n-grams of a length, as states and as next words of states
        grams = probs.join(retained[depth - 1].select("pre", "rest"), "pre").select(
            "key", (F.log10(F.col("prob") / F.col("parent")) - F.log10("rest")).alias("tree"), F.col("c").alias("n")
        )
        if depth < len(inner):
            grams = grams.union(inner[depth])
        summed = grams.groupBy("key").agg(F.max("n").alias("n"), F.sum("tree").alias("tree"))
        summed = summed.select("key", F.lit(None).cast("long").alias("c"), "n", "tree")
        values.append(common.stage(summed, "values", free=True))
        common.unstage(probs)
    words = counts.select(F.col("h").alias("key"), "c", F.col("c").alias("n"))
    if inner:
        words = words.join(inner[0].select("key", "tree"), "key", "left").withColumn("tree", F.coalesce("tree", F.lit(0.0)))
    else:
        words = words.withColumn("tree", F.lit(0.0))
    values.append(common.stage(words, "values", free=True))
    common.unstage(counts, *retained)
    return SuffixTree(reduce(DataFrame.union, values), int(n), int(v), states)


def _parts(total: float, at_once: float) -> int:
    return max(1, math.ceil(total / max(at_once, AT_ONCE)))


def _least(model: SuffixTree, share: float | None) -> float:
    """Count from which an n-gram's value goes to all tasks: that of the ``FREQUENT`` most frequent, or a share of the tokens."""
    if share is not None:
        return max(share * model.train_tokens, 1.0)
    eighth = F.floor(8 * F.log2("n")).alias("eighth")  # of a power of two
    least, total = math.inf, 0
    for row in sorted(model.values.groupBy(eighth).agg(F.count("*").alias("rows"), F.min("n").alias("n")).collect(), reverse=True):
        total += row.rows
        if total > FREQUENT:
            break
        least = float(row.n)
    return least


def _frequent(model: SuffixTree, least: float) -> tuple[Lookup, np.ndarray, np.ndarray]:
    """(lookup, word counts or -1, tree values) of the n-grams that occur ``least`` times in training."""
    rows = model.values.filter(F.col("n") >= F.lit(least)).select("key", "c", "tree").toArrow()
    keys = rows["key"].to_numpy().view("<u8")
    order = np.argsort(keys)
    c = rows["c"].fill_null(-1).to_numpy()[order]
    narrow = np.min_scalar_type(-1 - int(c.max(initial=0)))
    return Lookup(keys[order]), c.astype(narrow), rows["tree"].to_numpy()[order]


def score(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    model: SuffixTree | None = None,
    min_context: int = MIN_CONTEXT,
    min_entry: int = MIN_ENTRY,
    max_depth: int = MAX_DEPTH,
    frequent: float | None = None,
) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``model`` is a tree from :func:`train`; by default one is trained on all
    training documents, whole.  The values of the most frequent n-grams (``FREQUENT`` of them, or
    those that make up the share ``frequent`` of the training tokens) are
    added up where the documents lie; a document's other n-grams are shuffled to theirs
    by ranges of keys.  A null text is its end token.
    Repeated rows are each scored and count as often in training.  Without
    training documents every token has the base probability of an unseen one.
    """
    spark = common.prepare(docs.sparkSession)
    id_sql = common.id_type(docs, doc_id)
    own = common.only(docs, doc_id=doc_id, text=text)
    given, model = model, model or train(own, min_context, min_entry, max_depth)
    depth, least = len(model.states), _least(model, frequent)
    grams = bit_map(model.values.filter("c is null").select("key"))
    rare = model.values.filter(F.col("n") < F.lit(least))
    # n-grams that will be shuffled: the rare ones, and others that share a bit with one of the map's
    full = float(np.bitwise_count(grams).sum()) / (8 * len(grams))
    met = (rare.agg(F.sum("n")).first()[0] or 0) + model.train_tokens * sum(full**k for k in range(1, depth + 1))
    parts, meetings = _parts(met, COUNTED * model.train_tokens), _parts(met, MET * model.train_tokens)
    meetings = -(-meetings // parts)  # of each part, by ranges of keys
    tasks = common.pieces((met / parts + rare.count()) / meetings, GATHERED)
    bits = (max(BUCKETS * tasks, LEAST_BUCKETS) * meetings - 1).bit_length()
    held = _frequent(model, least), grams

    def run(batch: pa.RecordBatch, shared: Broadcast) -> pa.RecordBatch:
        (lookup, counts, tree), grams = shared.value
        keys, sizes = word_keys(common.text_bytes(batch.column(1)))
        n, place = len(sizes), places(sizes)
        doc = np.repeat(np.arange(n), sizes)
        base, ratio, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        rest, rest_doc = [], []
        here = np.ones(len(keys), bool)
        for size in range(1, depth + 2):
            if size > 1:
                keys = longer(keys)
                before = here  # its n-grams without the last and the first word have values, or it has none
                here = (place >= size - 1) & before
                here[1:] &= before[:-1]
                at = np.flatnonzero(here)
                here[at] = in_map(grams, keys[at])
            at = np.flatnonzero(here)
            found = lookup(keys[at])
            hit = found >= 0
            d, f = doc[at[hit]], found[hit]
            ratio += np.bincount(d, tree[f], n)
            if size == 1:
                c = counts[f]
                base += np.bincount(d, np.log10(np.maximum(c, 0) + 0.5), n)
                known += np.bincount(d, c >= 0, n).astype(np.int64)
            rest.append(keys[at[~hit]])
            rest_doc.append(doc[at[~hit]])
        order = np.argsort(np.concatenate(rest_doc), kind="stable")
        left = np.concatenate(rest)[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(rest_doc), minlength=n))])
        return common.record_batch(
            doc_id=batch.column(0),
            held_out=pa.array([is_held_out(d) for d in batch.column(0).to_pylist()], pa.bool_()),
            n_tokens=pa.array(sizes, pa.int64()),
            known=pa.array(known, pa.int64()),
            base=pa.array(base, pa.float64()),
            ratio=pa.array(ratio, pa.float64()),
            rest=pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(left.view("<i8"), pa.int64())),
        )

    schema = f"doc_id {id_sql}, held_out boolean, n_tokens long, known long, base double, ratio double, rest array<long>"
    rare = common.stage(_value_blocks(rare, bits), "rare", free=True)
    if given is None:
        common.unstage(model.values)
    mine = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    done = []
    for part in range(parts):
        some = own.filter(mine == part) if parts > 1 else own
        shared = spark.sparkContext.broadcast(held)
        scored = common.map_batches(some, partial(run, shared=shared), schema).withColumn("row", F.monotonically_increasing_id())
        scored = common.stage(scored, "scored", free=True)
        shared.destroy()  # and goes from all disks before anything is shuffled
        sums = [common.stage(_sums(scored, rare, bits, tasks, i, meetings), "sums", free=True) for i in range(meetings)]
        done.append(common.stage(_whole(scored, reduce(DataFrame.union, sums), model), "scores", free=True))
        common.unstage(scored, *sums)
    common.unstage(rare)
    return reduce(DataFrame.union, done)


_BLOCK = "bucket int, keys binary, rows binary, c binary, tree binary"


def _by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(order by key, buckets that have keys, the edges of these); a bucket is a range of keys."""
    order = np.argsort(keys)
    bucket = (keys[order] >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(_changes(bucket))
    return order, pa.array(bucket[first], pa.int32()), np.append(first, len(keys))


def _value_blocks(values: DataFrame, bits: int) -> DataFrame:
    """The values' keys, counts (-1: no word) and logarithms in blocks, by ranges of keys."""

    def blocks(got: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(got)
        keys, c, tree = rows["key"].to_numpy().view("<u8"), rows["c"].fill_null(-1).to_numpy(), rows["tree"].to_numpy()
        order, bucket, at = _by_bucket(keys, bits)
        none = pa.nulls(len(bucket), pa.binary())
        yield from _small(
            np.diff(at), bucket=bucket, keys=_packed(keys[order], at), rows=none, c=_packed(c[order], at), tree=_packed(tree[order], at)
        )

    return values.select("key", "c", "tree").mapInArrow(lambda batches: _flushed(batches, lambda b: b.num_rows, blocks), _BLOCK)


def _text_blocks(scored: DataFrame, bits: int, part: int, parts: int) -> DataFrame:
    """The keys that documents left over and the documents' rows in blocks, by ranges of keys; those of one of ``parts`` ranges."""

    def blocks(got: list[pa.RecordBatch]):
        keys = np.concatenate([b.column(1).flatten().to_numpy().view("<u8") for b in got])
        rows = np.concatenate([np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()) for b in got])
        if parts > 1:
            mine = np.flatnonzero((keys >> np.uint64(64 - bits)) * np.uint64(parts) >> np.uint64(bits) == part)
            keys, rows = keys[mine], rows[mine]
        if not len(keys):
            return
        order, bucket, at = _by_bucket(keys, bits)
        none = pa.nulls(len(bucket), pa.binary())
        yield from _small(np.diff(at), bucket=bucket, keys=_packed(keys[order], at), rows=_packed(rows[order], at), c=none, tree=none)

    size = lambda b: len(b.column(1).flatten())
    return scored.select("row", "rest").mapInArrow(lambda batches: _flushed(batches, size, blocks), _BLOCK)


def _flushed(batches, size, blocks):
    """The blocks of some ``_FLUSH`` numbers at a time."""
    got, n = [], 0
    for batch in batches:
        got.append(batch)
        n += size(batch)
        if n > _FLUSH:
            yield from blocks(got)
            got, n = [], 0
    if n:
        yield from blocks(got)


def _meet(batches, buckets: int):
    """Sums of the values that the documents' keys meet, in blocks by ``buckets`` of documents.

    Blocks come by bucket of keys, a bucket's values before its texts; a task holds the values
    of one bucket and some ``GATHERED`` keys, however many there are.  A document has keys in most
    tasks, so a row for each of its sums would be a row for each document and task.
    """
    values, table, texts, held = [], None, [], 0
    sums, n = [], 0

    def look():
        nonlocal table, texts, held, n
        if texts and table is None:
            keys, c, tree = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*values), ("<u8", "<i8", "<f8"))) if values else (np.zeros(0, t) for t in ("<u8", "<i8", "<f8"))
            order = np.argsort(keys)
            table = keys[order], c[order], tree[order]
        if texts and len(table[0]):
            keys, rows = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*texts), ("<u8", "<i8")))
            at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
            hit = np.flatnonzero(table[0][at] == keys)
            at, c = at[hit], table[1][at[hit]]
            sums.append((rows[hit], np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.5), 0.0), c >= 0, table[2][at]))
            n += len(hit)
        texts, held = [], 0

    def summed():
        nonlocal sums, n
        row, base, known, ratio = _by_row(sums)
        sums, n = [], 0
        bucket = (row % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(_changes(bucket[order]))
        at = np.append(first, len(row))
        yield from _small(
            np.diff(at),
            bucket=pa.array(bucket[order][first], pa.int32()),
            rows=_packed(row[order], at),
            base=_packed(base[order], at),
            known=_packed(known[order].astype("<u4"), at),
            ratio=_packed(ratio[order], at),
        )

    now = None
    for batch in batches:
        for bucket, keys, rows, c, tree in zip(*(x.to_pylist() for x in batch.columns)):
            if bucket != now:
                look()
                now, values, table = bucket, [], None
            if rows is None:
                values.append((keys, c, tree))
                continue
            texts.append((keys, rows))
            held += len(keys) // 8
            if held > GATHERED:
                look()
            if n > GATHERED:
                yield from summed()
    look()
    if n:
        yield from summed()


def _by_row(sums: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Equal rows once, with the sums of their other columns."""
    row, *columns = (np.concatenate(x) for x in zip(*sums))
    row, at = np.unique(row, return_inverse=True)
    return row, *(np.bincount(at, x, len(row)) for x in columns)


def _gather_sums(batches):
    """(row, base, known, ratio): each row of a task's blocks once."""
    got, size, known = [], 0, 0
    for batch in batches:
        got.append(tuple(map(_column, batch.columns[1:], ("<i8", "<f8", "<u4", "<f8"))))
        size += len(got[-1][0])
        if size > known + 2 * GATHERED:
            got = [_by_row(got)]
            size = known = len(got[0][0])
    if not got:
        return
    row, base, n, ratio = _by_row(got)
    for i in range(0, len(row), 1 << 16):
        j = i + (1 << 16)
        yield common.record_batch(
            row=pa.array(row[i:j], pa.int64()), base=pa.array(base[i:j]), known=pa.array(n[i:j].astype(np.int64)), ratio=pa.array(ratio[i:j])
        )


def _sums(scored: DataFrame, rare: DataFrame, bits: int, tasks: int, part: int, parts: int) -> DataFrame:
    """(row, base, known, ratio): what the values in ``rare`` of the keys in one of ``parts`` ranges add."""
    mine = rare.filter(F.shiftright(F.col("bucket").cast("long") * parts, bits) == part)
    both = mine.union(_text_blocks(scored, bits, part, parts)).repartition(tasks, "bucket")
    buckets = min(max(BUCKETS * tasks, LEAST_BUCKETS), 1 << 16)
    met = both.sortWithinPartitions("bucket", F.col("rows").isNotNull()).mapInArrow(
        partial(_meet, buckets=buckets), "bucket int, rows binary, base binary, known binary, ratio binary"
    )
    return met.repartition(tasks, "bucket").mapInArrow(_gather_sums, "row long, base double, known long, ratio double")


def _added_up(sums: DataFrame) -> DataFrame:
    return sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("base", "known", "ratio")])


def _whole(scored: DataFrame, sums: DataFrame, model: SuffixTree) -> DataFrame:
    """The scores of documents with what the values of their n-grams left over (``rest``) add."""
    sums = _added_up(sums).toDF("row", "more_base", "more_known", "more_ratio")
    whole = scored.drop("rest").join(sums, "row", "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    n_known = F.col("known") + more("more_known")
    base = (
        F.col("base")
        + F.coalesce("more_base", F.lit(0.0))
        + (F.col("n_tokens") - n_known) * F.lit(float(np.log10(0.5)))
        - F.col("n_tokens") * F.lit(model.log_total)
    )
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        n_known.alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("ratio") + F.coalesce("more_ratio", F.lit(0.0))).alias("score"),
    )
