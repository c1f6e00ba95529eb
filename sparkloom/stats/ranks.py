"""Ranks and inversions over whole tables, without one task for the whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..operators import ordered
from ..session import share_package

#: Rows of one block of the inversion count, the most that one may have, and the most blocks.
BLOCK_ROWS = 1 << 20
MOST_ROWS = 1 << 22
MOST_BLOCKS = 4096


def value_ranks(values: DataFrame, extra: dict | None = None, *, one_task_bytes: int | None = None) -> DataFrame:
    """(v, n, rank and the extra aggregates): each distinct value of ``v``, its count and mean rank."""
    counts = values.filter("v is not null").groupBy("v").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (extra or {}).items()])
    return counted_ranks(counts, one_task_bytes=one_task_bytes)


def counted_ranks(counts: DataFrame, *, one_task_bytes: int | None = None) -> DataFrame:
    """``rank`` beside distinct values ``v`` and their counts ``n``: the mean rank of the rows with that value."""
    upto = ordered.running(
        counts, [F.col("v").asc()], {"s": (F.sum, F.col("n"), lambda a, b: a + b)}, lambda p: p["s"], "upto",
        one_task_bytes=one_task_bytes,
    )
    return upto.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).drop("upto")


def ranked_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rx, ry): mean ranks of the complete pairs."""
    pairs = df.select(compat.col(x).cast("double").alias("x"), compat.col(y).cast("double").alias("y")).dropna()
    for c in ("x", "y"):
        ranks = value_ranks(pairs.select(F.col(c).alias("v"))).select(F.col("v").alias(c), F.col("rank").alias(f"r{c}"))
        pairs = pairs.join(ranks, c)
    return pairs.select("rx", "ry")


def inversions(values: np.ndarray) -> int:
    """Pairs in which an earlier value is larger, by merging sorted halves of growing size."""
    a, total, size = np.asarray(values), 0, 1
    n = len(a)
    while size < n:
        out = []
        for i in range(0, n, 2 * size):
            left, right = a[i : i + size], a[i + size : i + 2 * size]
            if len(right):
                total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            out.append(np.sort(a[i : i + 2 * size], kind="stable"))
        a, size = np.concatenate(out), 2 * size
    return total


def discordant_pairs(pairs: DataFrame, block_rows: int = BLOCK_ROWS) -> int:
    """Pairs of rows (x, y) that are ordered one way by x and the other by y.

    Rows in order of (x, y) are cut into blocks, and in order of y (then of their
    place by x, so that equal y add nothing) into bands of as many rows.
    Inversions inside a block or inside a band are counted by one task each;
    those between different blocks and bands follow from the cells' counts, a
    square of at most ``MOST_BLOCKS`` blocks and bands that is added up on the
    driver.  More rows than that square has room for are refused.
    """
    total_rows = pairs.count()
    block_rows = max(block_rows, -(-total_rows // MOST_BLOCKS))
    if block_rows > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS * MOST_BLOCKS} pairs")
    share_package(pairs.sparkSession)
    by_x = ordered.with_index(pairs, [F.col("x").asc(), F.col("y").asc()], "i")
    by_y = ordered.with_index(by_x.select("i", "y"), [F.col("y").asc(), F.col("i").asc()], "j")
    rows = by_y.select("i", F.col("j").alias("y"), F.expr(f"i div {block_rows}").alias("block"), F.expr(f"j div {block_rows}").alias("band"))

    def within(group: str, also_cells: bool):
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("i")
            n = inversions(pdf["y"].to_numpy())
            if also_cells:  # pairs of one block and one band are in both counts
                n -= sum(inversions(own["y"].to_numpy()) for _, own in pdf.groupby("block"))
            return pd.DataFrame({"n": [n]})

        return rows.groupBy(group).applyInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0

    total = within("block", False) + within("band", True)
    cells = rows.groupBy("block", "band").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros((int(cells["block"].max()) + 1, int(cells["band"].max()) + 1)) if len(cells) else np.zeros((1, 1))
    counts[cells["block"], cells["band"]] = cells["n"]
    earlier = np.cumsum(counts, axis=0) - counts  # the blocks before
    higher = np.cumsum(earlier[:, ::-1], axis=1)[:, ::-1] - earlier  # of these, in the bands above
    return int(total + (counts * higher).sum())
