"""Passes over a table that leave one array: numpy within the tasks, a tree of tasks to add up."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat
from ..session import share_package


def number(column: str) -> Column:
    return compat.col(column).cast("double")


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with a number in every column: no null and no NaN."""
    for c in columns:
        df = df.filter(compat.col(c).isNotNull() & ~F.isnan(number(c)))
    return df


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """A batch of number columns, or of one column of equally long arrays, as rows."""
    first = batch.column(0)
    if pa.types.is_list(first.type) or pa.types.is_large_list(first.type):
        return first.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def vectors(df: DataFrame, column: str) -> DataFrame:
    """One column ``v`` of double arrays; rows without one are left out."""
    c = compat.col(column)
    return df.filter(c.isNotNull()).select(c.cast(T.ArrayType(T.DoubleType())).alias("v"))


def added(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``fn`` of all batches of rows; an array of zeros for none.

    A task gives one array of the given shape, and a tree of tasks adds them, so
    that the driver gets few.
    """
    share_package(df.sparkSession)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += fn(matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["a"])

    parts = df.mapInArrow(run, "a binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(shape))
    none = df.sparkSession.sparkContext.parallelize([np.zeros(shape)], 1)
    return parts.union(none).treeReduce(np.add, depth=max(2, math.ceil(math.log(1 + parts.getNumPartitions(), 64))))


def uniform(keys: np.ndarray, draws: int, seed: int = 0) -> np.ndarray:
    """Numbers from 0 to 1, a row of ``draws`` for each whole number: the same ones whenever it is drawn again."""
    step, factor = np.uint64(0x9E3779B97F4A7C15), np.uint64((seed * 0xD1342543DE82EF95 + 1) % (1 << 64))
    with np.errstate(over="ignore"):
        v = (keys.astype(np.uint64) * np.uint64(draws))[:, None] + np.arange(draws, dtype=np.uint64)
        v = (v + factor) * step
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = (v ^ (v >> np.uint64(shift))) * np.uint64(by)
    return ((v ^ (v >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
