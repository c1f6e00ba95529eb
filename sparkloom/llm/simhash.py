"""SimHash near-duplicates with a generalised pigeonhole search.

Fingerprints at most ``distance`` bits apart are linked.  The 64 bits are split
into partitions of correlated bits.  If the partitions' thresholds sum to
``distance - partitions + 1``, two fingerprints within ``distance`` are within the
threshold in at least one partition; a threshold of -1 leaves a partition out.
Dynamic programming picks the thresholds (and the number of partitions) whose
estimated cost in probes and candidates is least.

Where 64 bits are too few to tell similarities apart, fingerprints have more
words of 64 bits: each is searched, all are compared.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected_components

BITS = 64
SEED = 42
#: A bucket of more than ``HOT`` fingerprints is compared in blocks of so many instead of by a join.
BLOCK = 8192
HOT = 48
#: For documents of which one of each group stays: shingles of five words, and fingerprints of 256 bits.
#: At a similarity of 0.8 about 39 of them differ, give or take six, and 8 or fewer in one of the four words.
KEEP_SHINGLE, KEEP_WORDS, KEEP_ONE, KEEP_ALL = 5, 4, 8, 46


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of all words, if they are fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    joined = memoryview(b" ".join(words))
    if len(words) <= size:
        return np.array([digest(joined, seed=SEED)], "<u8")
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*(s - 1 for s in starts[size:]), len(joined)]
    return np.fromiter((digest(joined[s:e], seed=SEED) for s, e in zip(starts, ends)), "<u8", len(ends))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; none without hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[i : i + (1 << 16)])
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, size: int = 4, words: int = 1) -> list[int]:
    """Words of 64 bits: set is a bit that is set in over half the hashes of the text's word shingles.

    The first word's hashes are the shingles' XXH64; each further word's are mixed from those.
    """
    hashes = shingle_hashes(text, size)
    out = [majority(hashes)]
    for k in range(1, words):
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(x ^ (x >> np.uint64(31))))
    return out


def _word_columns(words: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words))]


def with_fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """All columns of ``docs`` and ``fp`` (and ``fp1`` and so on, with more words), which replace columns of such names."""
    common.prepare(docs.sparkSession)
    added = _word_columns(words)
    docs = docs.drop(*added)
    at, names = docs.columns.index(text), [*docs.columns, *added]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t, shingle, words) for t in common.text_bytes(batch.column(at))]
        fps = np.array(found, "<u8").reshape(-1, words).view("<i8")
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(fps[:, k], pa.int64()) for k in range(words))], names=names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(a, T.LongType()) for a in added)])
    return common.map_batches(docs, run, schema)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) of every document; a null text or one without words has fingerprint zero."""
    return with_fingerprints(common.only(docs, doc_id=doc_id, text=text), shingle=shingle).drop("text")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have both bits i and j; over all rows."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(
                batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
            ).astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        yield common.record_batch(
            i=pa.array(range(-1, BITS * BITS), pa.int32()),
            c=pa.array([n, *both.astype("int64").ravel().tolist()], pa.int64()),
        )

    rows = fps.select("fp").mapInArrow(run, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(BITS * BITS + 1)
    for r in rows:
        counts[r.i + 1] = r.c
    return int(counts[0]), counts[1:].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Partitions of nearly equal size; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(related, 0)
    left, groups = set(range(BITS)), []
    for k in range(partitions):
        size = len(left) // (partitions - k)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (related[b, rest].sum(), -b))]
        while len(group) < size:
            more = [b for b in rest if b not in group]
            group.append(max(more, key=lambda b: (related[b, group].sum(), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def _within(group: list[int], p: np.ndarray, most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most 0, 1, ... most bits of the group."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for b in group:
        d = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return np.cumsum(chance).tolist()


#: What a row (filed, probing, or copied to another block) costs against one comparison in a join: by the stages'
#: times at 235,000 fingerprints some 0.8 microseconds, against 0.02.
ROW_COST = 40.0
#: A comparison within blocks against one in a join.
BLOCK_COMPARISON = 0.05


def _cost(n: int, chance: list[float], probes: float, threshold: int) -> float:
    """Estimated cost for each fingerprint of searching a partition."""
    bucket, candidates = n * chance[0], n * chance[threshold]
    if bucket <= HOT:
        return ROW_COST * (1 + probes) + candidates
    copies = max(1.0, bucket / BLOCK)
    return ROW_COST * 2 * probes * copies + BLOCK_COMPARISON * candidates


def allocate(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is searched, of least estimated cost."""
    p, best = np.diag(both) / max(n, 1), None
    for m in range(2, distance + 2):
        groups = group_bits(n, both, m)
        cost = []
        for g in groups:
            chance = _within(g, p, distance)
            probes = np.cumsum([float(comb(len(g), t)) for t in range(distance + 1)])
            cost.append([0.0] + [_cost(n, chance, probes[t], t) for t in range(distance + 1)])
        total = distance - m + 1
        # least[s]: (cost, thresholds) of the first groups with thresholds of sum s
        least = {0: (0.0, ())}
        for c in cost:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (spent, chosen) in least.items():
                for t in range(-1, distance + 1):
                    new = (spent + c[t + 1], (*chosen, t))
                    if s + t not in step or new < step[s + t]:
                        step[s + t] = new
            least = step
        found = (least[total][0], [(g, t) for g, t in zip(groups, least[total][1]) if t >= 0])
        if best is None or found[0] < best[0]:
            best = found
    return best[1]


def _signed_mask(bits) -> int:
    return common.signed(sum(1 << b for b in bits))


def links_within(fps: DataFrame, distance: int = 4, all_within: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect all pairs within ``distance``.

    ``fps`` has ``fp``, which then names its row, or also ``node`` (a name) and
    further words ``fp1`` and so on; with ``all_within``, a link must also be within
    that many bits of all words together.
    Every fingerprint is filed under its bits in each searched partition, and
    probes the values within the partition's threshold.  Small buckets are
    joined and verified.  In a bucket of over ``HOT`` fingerprints, blocks of
    ``BLOCK`` are compared with one another and only a spanning forest of each
    pair of blocks' links is kept: the same components from links in proportion
    to the rows, whatever the bucket's size.
    """
    n, both = bit_statistics(fps)
    plan = allocate(n, both, distance)
    more = [c for c in fps.columns if c not in ("fp", "node")]
    if "node" not in fps.columns:
        fps = fps.withColumn("node", F.col("fp"))
    lit = F.lit
    filed = F.array(*[F.struct(lit(i).alias("part"), lit(_signed_mask(g)).alias("mask")) for i, (g, _) in enumerate(plan)])
    index = fps.select("node", "fp", *more, F.explode(filed).alias("p")).select(
        F.col("p.part").alias("part"), F.expr("fp & p.mask").alias("key"), "node", "fp", *more
    )
    flips = F.array(
        *[
            F.struct(lit(i).alias("part"), lit(_signed_mask(g)).alias("mask"), lit(_signed_mask(flip)).alias("flip"))
            for i, (g, t) in enumerate(plan)
            for size in range(t + 1)
            for flip in combinations(g, size)
        ]
    )
    probes = fps.select("node", "fp", *more, F.explode(flips).alias("p")).select(
        F.col("p.part").alias("part"), F.expr("(fp & p.mask) ^ p.flip").alias("key"), "node", "fp", *more
    )

    sizes = index.groupBy("part", "key").agg(F.count("*").alias("size"))
    hot = common.stage(sizes.filter(F.col("size") > HOT), "hot")
    narrow = ["part", "key", "node", "fp"]
    other = index.select(narrow).join(hot, ["part", "key"], "left_anti").withColumnsRenamed({"fp": "other_fp", "node": "other"})
    # Spark's size estimates don't count what explode adds, so it must not pick a broadcast by them
    joined = (
        probes.select(narrow).hint("merge").join(other, ["part", "key"])
        .withColumn("apart", F.expr("bit_count(fp ^ other_fp)"))
        .filter(f"node < other and apart <= {distance}")
        .select(F.col("node").alias("a"), F.col("other").alias("b"), "apart")
    )
    if all_within is not None:
        words = lambda name: fps.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in more])
        apart = " + ".join(["apart", *(f"bit_count(a_{c} ^ b_{c})" for c in more)])
        joined = joined.distinct().join(words("a"), "a").join(words("b"), "b").filter(f"{apart} <= {all_within}")
    return joined.select("a", "b").union(_hot_links(index, probes, hot, distance, more, all_within))


def _hot_links(
    index: DataFrame, probes: DataFrame, hot: DataFrame, distance: int, more: list[str], all_within: int | None
) -> DataFrame:
    """Spanning links of each pair of blocks in the buckets of ``hot`` (part, key, size)."""
    own_probes = probes.select("part", "key").hint("merge").join(hot, ["part", "key"])
    counts = own_probes.groupBy("part", "key").agg(F.count("*").alias("n_probes"))
    blocks = hot.join(counts, ["part", "key"]).select(
        "part",
        "key",
        F.expr(f"cast(ceil(size / {BLOCK}) as int)").alias("xs"),
        F.expr(f"cast(ceil(n_probes / {BLOCK}) as int)").alias("qs"),
    )
    spot = lambda c: F.expr(f"cast(pmod(xxhash64(node), {c}) as int)")
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = ["node", "fp", *more]
    x = index.hint("merge").join(blocks, ["part", "key"]).select("part", "key", spot("xs").alias("x"), span("qs").alias("q"), *own)
    q = probes.hint("merge").join(blocks, ["part", "key"]).select("part", "key", span("xs").alias("x"), spot("qs").alias("q"), *own)
    sides = x.withColumn("side", F.lit(0)).unionByName(q.withColumn("side", F.lit(1)))

    def run(table: pa.Table) -> pa.Table:
        words = np.stack([table[c].to_numpy().view("<u8") for c in own[1:]])
        node, side = table["node"].to_numpy(), table["side"].to_numpy()
        asks = side == 1
        a, b = spanning(node[asks], words[:, asks], node[~asks], words[:, ~asks], distance, all_within)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sides.groupBy("part", "key", "x", "q").applyInArrow(run, "a long, b long")


def spanning(
    asking: np.ndarray, ask_words: np.ndarray, filed: np.ndarray, filed_words: np.ndarray, distance: int, all_within: int | None = None
) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two sets of named fingerprints; words are (word, fingerprint).

    Each name has the label of its tree; links within a tree are passed over all at
    once, so that a large group of near copies takes no step for each pair.
    """
    nodes, place = np.unique(np.concatenate([filed, asking]), return_inverse=True)
    labels = np.arange(len(nodes))
    filed_at, asking_at = place[: len(filed)], place[len(filed) :]
    a, b = [], []
    first = np.ascontiguousarray(filed_words[0])
    for q, at, words in zip(asking.tolist(), asking_at.tolist(), ask_words.T):
        near = np.flatnonzero(np.bitwise_count(first ^ words[0]) <= distance)
        near = near[labels[filed_at[near]] != labels[at]]
        if all_within is not None and len(near):
            near = near[np.bitwise_count(filed_words[:, near] ^ words[:, None]).sum(0, dtype=np.int64) <= all_within]
        if len(near):
            trees, one = np.unique(labels[filed_at[near]], return_index=True)
            a += [q] * len(one)
            b += filed[near[one]].tolist()
            labels[np.isin(labels, trees)] = labels[at]
    return a, b


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id.

    The component is the smallest ``doc_id`` reachable over links of at most
    ``distance`` bits.  Equal fingerprints are brought together first, so
    exact copies cost one row each and are never paired.  Documents without
    words share fingerprint zero and are linked like any other; a document
    without an id belongs to its component and never names it, unless none
    there has an id; rows that share an id are each returned, with their own
    text's component.
    """
    fps = common.stage(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    distinct = common.stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    nodes = connected_components(links_within(distinct.select("fp"), distance))
    linked = distinct.join(nodes, distinct.fp == nodes.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    linked = common.stage(linked, "linked")
    names = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = linked.join(names, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = KEEP_SHINGLE,
    words: int = KEEP_WORDS,
    distance: int = KEEP_ONE,
    all_within: int | None = KEEP_ALL,
) -> DataFrame:
    """One document of each group of near duplicates; columns unchanged.

    Documents are linked if their fingerprints differ by at most ``distance`` bits in one
    of their words of 64 and ``all_within`` of all; groups are what links connect.
    The row with the smallest ``doc_id`` stays (then that with the smallest
    fingerprint, then the first read); one without an id only where
    none there has one.  Rows go by themselves, not by their ids: of rows that share an
    id, each belongs to the group of its own text, and of equal rows one stays.
    Documents without words are copies of one another.
    """
    names = _word_columns(words)
    # the columns pass by under names of ours, so that they can't clash
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at_id, at_text = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    marked = with_fingerprints(own, text=at_text, shingle=shingle, words=words)
    marked = common.stage(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    place = F.struct(F.col(at_id).isNull().alias("none"), F.col(at_id).alias("id"), *names, "row")
    distinct = common.stage(marked.groupBy(*names).agg(F.min(place).alias("first")), "distinct")
    distinct = distinct.withColumn("node", F.col("first.row"))
    links = None
    for k in range(words):  # each word in turn is the one searched
        turned = distinct.select("node", *[F.col(names[(k + i) % words]).alias(n) for i, n in enumerate(names)])
        found = common.stage(links_within(turned, distance, all_within if words > 1 else None), "found")
        links = found if links is None else links.union(found)
    nodes = connected_components(links)
    linked = distinct.join(nodes, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    linked = common.stage(linked, "linked")
    kept = linked.groupBy("component").agg(F.min("first").alias("best"))
    stays = linked.join(kept, "component").select("node", F.col("best.row").alias("stays"))
    of_rows = marked.select("row", *names).join(distinct.select("node", *names), names).join(stays, "node")
    gone = common.stage(of_rows.filter("row <> stays").select("row"), "gone")
    return marked.join(gone, "row", "left_anti").select(*own.columns).toDF(*docs.columns)
