"""A trie over the turns of conversations: succinct level-order tries per prefix shard.

A node is known by the hash of its sequence of turns (128 bits, a running xor of
the turns' hashes with their places), so that nodes are counted by one aggregate
and texts never leave the scan.  Nodes with few rows below them are dealt to
shards by the topmost such node over them; numpy builds one level-order trie for
each shard and rolls it up from the leaves.  The heavy levels above are merged
as tables, along the paths of the conversations that stand for their nodes.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from . import common

#: Rows below a node from which it belongs to the heavy upper levels; also the nodes of a shard, about.
SHARD_ROWS = 1 << 17
#: Fewer rows than this aren't worth a level of their own, however many tasks there are.
LEAST_ROWS = 512
#: Ids that are joined to one string on the way to a node's hash.
CHUNK_IDS = 4096


class Louds:
    """A level-order unary degree sequence: for each node, a one for each child and a zero.

    Node 0 is the root; nodes are numbered level by level.  ``labels[i]`` is node i's.
    """

    def __init__(self, degrees: np.ndarray, labels: np.ndarray):
        self.labels = labels
        zeros = np.cumsum(degrees) + np.arange(len(degrees))
        self.bits = np.ones(len(degrees) + int(degrees.sum()), bool)
        self.bits[zeros] = False
        self.zeros = zeros

    def parents(self) -> np.ndarray:
        """Of nodes 1, 2, ...: the zeros before the one that stands for the node."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        return np.diff(self.zeros, prepend=-1) - 1

    def children(self, node: int) -> range:
        """The node's children, which lie side by side."""
        start = int(self.zeros[node - 1]) + 1 - node if node else 0
        return range(start + 1, int(self.zeros[node]) - node + 1)

    def child(self, node: int, label: int) -> int | None:
        """The child by its label; siblings are in order of their labels."""
        own = self.children(node)
        at = int(np.searchsorted(self.labels[own.start : own.stop], label))
        return own.start + at if at < len(own) and self.labels[own.start + at] == label else None


def _same(*keys: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Small numbers for pairs of 64-bit keys; equal pairs get the same one."""
    a, b = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new) - 1
    return np.split(out, np.cumsum([len(k[0]) for k in keys])[:-1])


def level_order(level: np.ndarray, keys: tuple[np.ndarray, np.ndarray], above: tuple[np.ndarray, np.ndarray]) -> tuple[Louds, np.ndarray, list[slice]]:
    """The trie of a forest under one root, its nodes' rows (from node 1 on), and the levels.

    ``level`` is 1 for the trees' roots; ``above`` are the keys of the nodes' parents.
    A label is what the last turn adds to the key.
    """
    n = len(level)
    own, parent = _same(keys, above)
    row_of = np.full(2 * n + 1, -1)
    row_of[own] = np.arange(n)
    up = np.where(level > 1, row_of[parent], -1)
    label = keys[0] ^ above[0]
    node = np.zeros(n + 1, np.int64)  # of each row; the last is the root
    by_level = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by_level], np.arange(1, (int(level.max()) if n else 0) + 2))
    rows, levels = [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own_rows = by_level[lo:hi]
        own_rows = own_rows[np.lexsort((label[own_rows], node[up[own_rows]]))]
        node[own_rows] = np.arange(lo + 1, hi + 1)
        rows.append(own_rows)
        levels.append(slice(lo + 1, hi + 1))
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    degrees = np.bincount(node[up[rows]], minlength=n + 1)
    return Louds(degrees, np.concatenate([[0], label[rows]])), rows, levels


def roll_up(trie: Louds, levels: list[slice], *values: np.ndarray) -> None:
    """Add every node's values to its parent's, from the last level to the first."""
    parents = trie.parents()
    for level in reversed(levels):
        up = parents[level.start - 1 : level.stop - 1]
        for v in values:
            np.add.at(v, up, v[level])


def _shard(table: pa.Table) -> pa.Table:
    """A shard's nodes with their rollups."""
    col = {name: table.column(name).to_numpy() for name in table.column_names}
    trie, rows, levels = level_order(col["level"], (col["k1"], col["k2"]), (col["p1"], col["p2"]))
    degrees = trie.degrees()
    leaves = (degrees == 0).astype(np.int64)
    saved = np.concatenate([[0], ((col["n_convs"] - 1) * col["bytes"])[rows]])
    roll_up(trie, levels, leaves, saved)
    conv = np.concatenate([[0], col["conv"][rows]])
    parents = trie.parents()
    return pa.table(
        {
            **{k: col[k][rows] for k in ("k1", "k2", "p1", "p2", "depth", "level")},
            "conv": conv[1:],
            "up": np.where(parents > 0, conv[parents], col["up"][rows]),
            "n_convs": col["n_convs"][rows],
            "n_children": degrees[1:],
            "n_leaves": leaves[1:],
            "saved": saved[1:],
        }
    )


_NODE = "k1 long, k2 long, p1 long, p2 long, depth long, level long, conv long, up long, n_convs long, n_children long, n_leaves long, saved long"


def ordered_turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, t1, t2, bytes): the turns' places from 1 on, 128 bits for role and text, and the text's UTF-8 bytes.

    Turns without a number come first; equal numbers are put in order of the hash, so that
    equal rows are turns one after the other.  Null roles and texts are empty.
    Rows without a conversation are left out.
    """
    rows = common.only(conversations, conv=conv_id, turn=turn, role=role, text=text).filter("conv is not null")
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = rows.select(
        F.col("conv").cast("long").alias("conv"),
        "turn",
        F.xxhash64(F.lit(1), role_, text_).alias("t1"),
        F.xxhash64(F.lit(2), text_, role_).alias("t2"),
        F.octet_length(text_).cast("long").alias("bytes"),
    )
    hashed = common.stage(hashed, "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    return ordered.ranked(hashed, order, ["turn", "t1", "t2"], "pos", "row_number", within=["conv"]).drop("turn")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, size) of every conversation."""
    return turns.groupBy("conv").agg(F.max("pos").alias("size"))


def regrown(turns: DataFrame, *, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first one of their group: (turns, sizes).

    Conversation c takes the first h turns of conversation c - c % ``group`` (all
    if it has fewer, none if there is no such conversation) and then its own
    turns after its first h; h is crc32(c in decimal) % ``most``.  The remainder has
    the sign of c, as in SQL.  A conversation may have no turns left; it has a size
    of 0 then.
    """
    sizes = lengths(turns)
    heads = sizes.select(
        "conv",
        "size",
        (F.col("conv") - F.col("conv") % group).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"),
    )
    base = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    own_base = F.col("conv") == F.col("base")
    heads = common.stage(
        heads.join(base, "base", "left").select(
            "conv",
            "base",
            F.when(own_base, 0).otherwise(F.col("h")).alias("h"),
            F.when(own_base, 0).otherwise(F.least("h", F.coalesce("base_size", F.lit(0)))).alias("head"),
            "size",
        ),
        "heads",
    )
    copied = (
        turns.filter(F.col("pos") < most)
        .withColumnRenamed("conv", "base")
        .join(heads.filter("head > 0").select("conv", "base", "head"), "base")
        .filter("pos <= head")
        .select("conv", "pos", "t1", "t2", "bytes")
    )
    kept = (
        turns.join(heads.select("conv", "h", "head"), "conv")
        .filter("pos > h")
        .select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "t1", "t2", "bytes")
    )
    left = heads.select("conv", (F.col("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).cast("long").alias("size"))
    return copied.unionByName(kept), left


def _ends(rows: DataFrame, chunk_ids: int) -> DataFrame:
    """(k1, k2, ends): the hash of the conversations that end in each node, in order of their ids.

    Ids are sorted by range, a node with very many being dealt to several tasks,
    and joined to strings there; only these strings meet, in order, in the task that
    feeds them to a node's hash.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["k1", "k2", "conv"]

    def join(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:3]]
            out = []
            for (a, b), own in groupby(zip(*columns), key=lambda r: r[:2]):
                ids = [r[2] for r in own]
                out += [(a, b, ids[i], ",".join(map(str, ids[i : i + chunk_ids]))) for i in range(0, len(ids), chunk_ids)]
            names = ("k1", "k2", "first", "ids")
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield common.record_batch(**{n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types))})

    def digest(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("ids").to_pylist()):
                if key != (a, b):
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    sorted_ids = rows.select(*key).repartitionByRange(parts, *key).sortWithinPartitions(*key)
    chunks = sorted_ids.mapInArrow(join, "k1 long, k2 long, first long, ids string")
    dealt = chunks.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return dealt.mapInArrow(digest, "k1 long, k2 long, ends string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string())
    return common.record_batch(**{n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("k1", "k2", "ends"), types))})


def prefix_trie(turns: DataFrame, sizes: DataFrame, *, shard_rows: int = SHARD_ROWS, least_rows: int = LEAST_ROWS, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """One row for each distinct sequence of first turns, the empty one included.

    ``turns`` is (conv, pos, t1, t2, bytes) with places from 1 on without gaps, ``sizes``
    (conv, size) of every conversation, also of those without turns.  Returns
    conv_id (the smallest conversation that starts so), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves (childless nodes from
    this one down), saved_tokens (from this one down, the bytes of each node's last
    turn for every conversation but one) and ends_sha256 (of the ids of the
    conversations that end here, ascending, comma-joined).  No conversations
    give no nodes.  Equal conversations share all their nodes; however many they are,
    their rows are counted with a map-side part.
    """
    spark = common.prepare(turns.sparkSession)
    place = F.xxhash64("pos", "t1", "t2"), F.xxhash64("pos", "t2", "t1", "bytes")
    marked = turns.select("conv", F.col("pos").cast("long").alias("pos"), "bytes", place[0].alias("x1"), place[1].alias("x2"))
    xor = lambda a, b: a.bitwiseXOR(b)
    keyed = ordered.running(
        marked,
        [F.col("pos")],
        {"k1": (F.bit_xor, F.col("x1"), xor), "k2": (F.bit_xor, F.col("x2"), xor)},
        lambda p: F.struct(p["k1"].alias("k1"), p["k2"].alias("k2")),
        "key",
        within=[F.col("conv")],
    )
    rows = common.stage(
        keyed.join(sizes, "conv").select(
            "conv", F.col("pos").alias("depth"), "key.k1", "key.k2",
            xor(F.col("key.k1"), F.col("x1")).alias("p1"), xor(F.col("key.k2"), F.col("x2")).alias("p2"), "bytes", "size",
        ),
        "prefixes",
    )
    counted = rows.groupBy("k1", "k2").agg(
        F.min("depth").alias("depth"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.count("*").alias("n_convs"),
        F.min("conv").alias("conv"),
        F.min("bytes").alias("bytes"),
        F.sum(F.col("size") - F.col("depth") + 1).alias("below"),
    )
    nodes = common.stage(counted, "nodes")
    # one row each
    whole = sizes.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    if not whole["n"]:
        return _result(spark.createDataFrame([], _NODE), spark.createDataFrame([], "k1 long, k2 long, ends string"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_convs"), F.lit(0)).alias("rows")).first()
    bound = min(shard_rows, max(least_rows, sums["rows"] // (2 * parts)))
    heavy = nodes.filter(F.col("below") > bound)
    light = nodes.filter(F.col("below") <= bound)

    # where each conversation's path goes through heavy nodes; these are its first ones
    through = common.stage(
        rows.select("conv", "k1", "k2").join(heavy.select("k1", "k2", "depth", F.col("conv").alias("owner")), ["k1", "k2"]), "heavy"
    )
    covered = through.groupBy("conv").agg(F.max("depth").alias("heavy_depth"), F.max_by("owner", "depth").alias("up"))
    stand_in = light.select("conv").distinct()
    tops = (
        rows.select("conv", "depth", F.col("k1").alias("s1"), F.col("k2").alias("s2"))
        .join(stand_in, "conv", "left_semi")
        .join(covered, "conv", "left")
        .filter(F.col("depth") == F.coalesce("heavy_depth", F.lit(0)) + 1)
        .select("conv", "s1", "s2", F.coalesce("heavy_depth", F.lit(0)).alias("above"), F.coalesce("up", F.lit(whole["conv"])).alias("up"))
    )
    shards = max(parts, common.pieces(sums["n"], shard_rows))
    dealt = light.join(tops, "conv").select(
        F.pmod(F.xxhash64("s1", "s2"), F.lit(shards)).alias("shard"),
        (F.col("depth") - F.col("above")).alias("level"),
        "k1", "k2", "p1", "p2", "depth", "conv", "up", "n_convs", "bytes",
    )
    built = common.stage(dealt.groupBy("shard").applyInArrow(_shard, _NODE), "tries")

    upper = _upper(spark, heavy, built.filter("level = 1"), through, whole)
    ended = rows.filter("depth = size").select("k1", "k2", "conv")
    none = sizes.filter("size = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv")
    return _result(built.unionByName(upper), _ends(ended.unionByName(none), chunk_ids))


def _upper(spark, heavy: DataFrame, tops: DataFrame, through: DataFrame, whole) -> DataFrame:
    """The heavy nodes and the root, with what lies below them.

    A node's rollup is a sum over the nodes below it, each counted by one
    conversation, the smallest that goes through it: summed along the
    conversation's path from its last heavy node up, then by node over all
    conversations.  Only conversations that stand for a node take part.
    """
    root = spark.createDataFrame([(0, 0, None, None, 0, whole["conv"], whole["n"], 0)], "k1 long, k2 long, p1 long, p2 long, depth long, conv long, n_convs long, bytes long")
    upper = heavy.select(*root.columns).unionByName(root)
    below = tops.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    within = heavy.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    children = below.unionByName(within).groupBy("p1", "p2").agg(*[F.sum(c).alias(c) for c in ("n", "leaves", "saved")])
    children = children.withColumnsRenamed({"p1": "k1", "p2": "k2"})
    own = common.stage(
        upper.join(children, ["k1", "k2"], "left").select(
            *root.columns,
            F.coalesce("n", F.lit(0)).alias("n_children"),
            F.when(F.col("n") > 0, F.col("leaves")).otherwise(1).cast("long").alias("own_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))).alias("own_saved"),
        ),
        "upper",
    )
    owners = own.select("conv").distinct()
    zero = F.lit(0).cast("long")
    paths = through.select("conv", "k1", "k2", "depth").unionByName(owners.select("conv", zero.alias("k1"), zero.alias("k2"), zero.alias("depth")))
    values = own.select("k1", "k2", F.col("conv").alias("owner"), "own_leaves", "own_saved")
    mine = F.col("conv") == F.col("owner")
    steps = (
        paths.join(owners, "conv", "left_semi")
        .join(values, ["k1", "k2"])
        .select("conv", "k1", "k2", "depth", *[F.when(mine, F.col(c)).otherwise(0).alias(c) for c in ("own_leaves", "own_saved")])
    )
    add = lambda a, b: a + b
    summed = ordered.running(
        steps,
        [F.col("depth").desc()],
        {c: (F.sum, F.col(c), add) for c in ("own_leaves", "own_saved")},
        lambda p: F.struct(p["own_leaves"].alias("leaves"), p["own_saved"].alias("saved")),
        "sums",
        within=[F.col("conv")],
    )
    rolled = summed.groupBy("k1", "k2").agg(F.sum("sums.leaves").alias("n_leaves"), F.sum("sums.saved").alias("saved"))
    parent = own.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("up"))
    return (
        own.join(rolled, ["k1", "k2"])
        .join(parent, ["p1", "p2"], "left")
        .select("k1", "k2", "p1", "p2", "depth", zero.alias("level"), "conv", "up", "n_convs", "n_children", "n_leaves", "saved")
    )


def _result(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    return nodes.join(ends, ["k1", "k2"], "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("up").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    group: int | None = None,
    most: int = 9,
    shard_rows: int = SHARD_ROWS,
    least_rows: int = LEAST_ROWS,
    chunk_ids: int = CHUNK_IDS,
) -> DataFrame:
    """The trie of whole conversations: see :func:`ordered_turns` and :func:`prefix_trie`.

    With ``group``, conversations are first :func:`regrown`.  Null roles and texts are
    empty, turns without a number come first, rows without a conversation are left
    out; repeated rows are turns of their own; texts count whole, however long.
    Other columns are left out, whatever their names; no rows give no nodes.
    """
    common.prepare(conversations.sparkSession)
    turns = common.stage(ordered_turns(conversations, conv_id=conv_id, turn=turn, role=role, text=text), "turns")
    if group:
        turns, sizes = regrown(turns, group=group, most=most)
    else:
        sizes = lengths(turns)
    return prefix_trie(turns, sizes, shard_rows=shard_rows, least_rows=least_rows, chunk_ids=chunk_ids)
