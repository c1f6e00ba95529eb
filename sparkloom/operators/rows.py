"""Row operations: order, limits, samples and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import compat
from . import ordered
from .registry import step


@step()
def sort_rows(df: DataFrame, sort=()) -> DataFrame:
    """Rows in order of {column, direction, nulls}; nulls last by default."""
    return df.orderBy(*compat.keys(sort)) if sort else df


@step()
def limit_rows(df: DataFrame, n=None) -> DataFrame:
    """The first ``n`` rows."""
    return df if n is None else df.limit(int(n))


@step()
def offset_rows(df: DataFrame, n=None) -> DataFrame:
    """All but the first ``n`` rows."""
    return df if n is None else df.offset(int(n))


@step()
def sample_rows(df: DataFrame, n=None, frac=None) -> DataFrame:
    """``n`` rows at random, else about a share ``frac`` of them."""
    if n is not None:
        return df.orderBy(F.rand()).limit(int(n))
    return df if frac is None else df.sample(withReplacement=False, fraction=float(frac))


@step()
def distinct_rows(df: DataFrame, columns=()) -> DataFrame:
    """Distinct rows, of the listed columns if there are any."""
    return (df.select(*compat.cols(columns)) if columns else df).distinct()


@step()
def remove_duplicates(df: DataFrame, by=(), order_by=()) -> DataFrame:
    """The first row of each key by ``order_by``; without keys, distinct rows.

    The first is found by an aggregate with a map-side part, so a key with very
    many rows sends one row from each task.
    """
    by = compat.names(by)
    if not by:
        return df.distinct()
    if not order_by:
        return df.dropDuplicates(by)
    first = W.partitionBy(*compat.cols(by)).orderBy(*compat.keys(order_by))
    # Spark keeps each task's first rows before it shuffles (a window group limit)
    return df.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")


@step()
def add_index_column(df: DataFrame, name="index", start=1, order_by=None, one_task_bytes=None) -> DataFrame:
    """Row numbers from ``start``, in scan order or by ``order_by``."""
    if order_by:
        keys = compat.keys(order_by)
        if ordered.is_small(df, one_task_bytes):
            return df.withColumn(name, F.row_number().over(W.orderBy(*keys)).cast("bigint") - 1 + int(start))
        return ordered.with_index(df, keys, name).withColumn(name, F.col(name) + int(start))
    own = df.withColumn("__id", F.monotonically_increasing_id())
    if ordered.is_small(df, one_task_bytes):
        return own.withColumn(name, F.row_number().over(W.orderBy("__id")).cast("bigint") - 1 + int(start)).drop("__id")
    own = own.withColumn("__part", F.shiftright("__id", 33))
    # a row for each partition of the scan
    counts = own.groupBy("__part").agg(F.count("*").alias("n"))
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__start"))
    within = F.col("__id") - F.shiftleft(F.col("__part"), 33)
    return own.join(starts, "__part").withColumn(name, F.col("__start") + within + int(start)).drop("__id", "__part", "__start")


@step()
def top_n(df: DataFrame, column=None, n=10, direction="desc") -> DataFrame:
    """The ``n`` rows with the largest values."""
    return df.orderBy(compat.ordered(column, direction)).limit(int(n)) if column else df


@step()
def bottom_n(df: DataFrame, column=None, n=10) -> DataFrame:
    """The ``n`` rows with the smallest values."""
    return df.orderBy(compat.ordered(column)).limit(int(n)) if column else df


@step()
def random_sample(df: DataFrame, n=None, seed=None) -> DataFrame:
    """``n`` rows at random; a seed makes the choice repeatable for the same partitions."""
    if n is None:
        return df
    return df.orderBy(F.rand() if seed is None else F.rand(hash(float(seed)) & 0x7FFFFFFF)).limit(int(n))
