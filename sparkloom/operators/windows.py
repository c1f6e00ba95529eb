"""Window functions over an order, with or without a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import compat
from . import ordered
from .registry import step
from .statistics import _plus, _rolling, running_sum


def _parts(partition_by) -> list[Column]:
    return compat.cols(compat.names(partition_by))


def _moved(df, fn, column, offset, order_by, default, partition_by, name, one_task_bytes) -> DataFrame:
    if not column or not order_by:
        return df
    n, keys = int(offset), compat.keys(order_by)
    value = lambda w: fn(compat.col(column), n, default).over(w)
    back = n if fn is F.lag else -n
    return ordered.trailing(
        df, keys, max(back, 0), max(-back, 0), value, name, within=_parts(partition_by), one_task_bytes=one_task_bytes
    )


@step()
def lag_column(df: DataFrame, column=None, offset=1, order_by=None, default=None, partition_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """The value some rows before."""
    return _moved(df, F.lag, column, offset, order_by, default, partition_by, name or f"{column}_lag{offset}", one_task_bytes)


@step()
def lead_column(df: DataFrame, column=None, offset=1, order_by=None, default=None, partition_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """The value some rows after."""
    return _moved(df, F.lead, column, offset, order_by, default, partition_by, name or f"{column}_lead{offset}", one_task_bytes)


def _items(order_by) -> list:
    return [order_by] if isinstance(order_by, (str, dict)) else list(order_by)


def _names(order_by) -> list[str]:
    return [i if isinstance(i, str) else i["column"] for i in _items(order_by)]


def _renamed(order_by) -> list[Column]:
    """The same order over columns named ``__o0`` and so on."""
    return compat.keys([f"__o{k}" if isinstance(i, str) else {**i, "column": f"__o{k}"} for k, i in enumerate(_items(order_by))])


def _picked(df: DataFrame, column, order_by, partition_by, name, which: str, n: int = 1, one_task_bytes=None) -> DataFrame:
    """One row's value for all rows of its partition.

    Without a partition the row is found by a top-n of the whole table and
    joined to every row.  With one, a small table takes a window; in a large
    one the row is found by its number (counted from the other end for the last)
    and joined to its partition, whose rows Spark may split.
    """
    if not column or not order_by:
        return df
    c, keys = compat.col(column), compat.keys(order_by)
    if partition_by and ordered.is_small(df, one_task_bytes):
        w = W.partitionBy(*_parts(partition_by)).orderBy(*keys)
        w = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        value = {"first": F.first(c), "last": F.last(c), "nth": F.nth_value(c, n)}[which]
        return df.withColumn(name, value.over(w))
    if partition_by:
        parts = _parts(partition_by)
        one = {"s": (F.sum, F.lit(1), _plus)}
        own = df.select(*[p.alias(f"__p{i}") for i, p in enumerate(parts)], c.alias("__picked"), *[k.alias(f"__o{i}") for i, k in enumerate(compat.cols(_names(order_by)))])
        by = [F.col(f"__p{i}") for i in range(len(parts))]
        numbered = ordered.running(own, _renamed(order_by), one, lambda p: p["s"], "__i", within=by, one_task_bytes=one_task_bytes)
        if which == "last":
            sizes = own.groupBy(*by).agg(F.count("*").alias("__i"))
            same = [F.col("__i") == F.col("__n"), *[b.eqNullSafe(F.col(f"__to{i}")) for i, b in enumerate(by)]]
            ends = sizes.select(F.col("__i").alias("__n"), *[b.alias(f"__to{i}") for i, b in enumerate(by)])
            row = numbered.join(ends, same)
        else:
            row = numbered.filter(F.col("__i") == n)
        row = row.select(*[b.alias(f"__to{i}") for i, b in enumerate(by)], F.col("__picked").alias(name))
        same = [p.eqNullSafe(F.col(f"__to{i}")) for i, p in enumerate(parts)]
        return df.drop(name).join(row, same, "left").drop(*[f"__to{i}" for i in range(len(parts))])
    if which == "last":
        items = [order_by] if isinstance(order_by, (str, dict)) else list(order_by)
        flipped = [
            {
                "column": i if isinstance(i, str) else i["column"],
                "direction": "asc" if isinstance(i, dict) and str(i.get("direction", "asc")).lower() == "desc" else "desc",
                "nulls": "first" if not (isinstance(i, dict) and str(i.get("nulls")).lower() == "first") else "last",
            }
            for i in items
        ]
        row = df.orderBy(*compat.keys(flipped)).limit(1)
    else:
        row = df.orderBy(*keys).limit(n)
        row = row.offset(n - 1) if n > 1 else row
    picked = row.select(c.alias("__picked"))
    # at most one row; an aggregate gives a null where there is none
    return df.crossJoin(F.broadcast(picked.agg(F.first("__picked").alias(name))))


@step()
def first_value(df: DataFrame, column=None, order_by=None, partition_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """The value of the first row."""
    return _picked(df, column, order_by, partition_by, name or f"{column}_first", "first", one_task_bytes=one_task_bytes)


@step()
def last_value(df: DataFrame, column=None, order_by=None, partition_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """The value of the last row."""
    return _picked(df, column, order_by, partition_by, name or f"{column}_last", "last", one_task_bytes=one_task_bytes)


@step()
def nth_value(df: DataFrame, column=None, n=1, order_by=None, partition_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """The value of the n-th row; null if there are fewer."""
    return _picked(df, column, order_by, partition_by, name or f"{column}_nth{n}", "nth", int(n), one_task_bytes)


@step()
def running_total(df: DataFrame, column=None, order_by=None, partition_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Sum up to each row."""
    return running_sum(df, column, order_by, partition_by, name or f"{column}_running_total", one_task_bytes)


def _running(df, column, order_by, partition_by, name, partials, value, one_task_bytes) -> DataFrame:
    if not column or not order_by:
        return df
    keys, c = compat.keys(order_by), compat.col(column)
    full = {k: (agg, c, combine) for k, (agg, combine) in partials.items()}
    if "n" in full:  # counts of blocks are summed, not counted
        full = {"s": (F.sum, c, _plus), "n": (F.sum, c.isNotNull().cast("bigint"), _plus)}
    return ordered.running(df, keys, full, value, name, within=_parts(partition_by), one_task_bytes=one_task_bytes)


@step()
def running_min(df: DataFrame, column=None, order_by=None, partition_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Least value up to each row."""
    return _running(df, column, order_by, partition_by, name or f"{column}_running_min", {"m": (F.min, F.least)}, lambda p: p["m"], one_task_bytes)


@step()
def running_max(df: DataFrame, column=None, order_by=None, partition_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Largest value up to each row."""
    return _running(df, column, order_by, partition_by, name or f"{column}_running_max", {"m": (F.max, F.greatest)}, lambda p: p["m"], one_task_bytes)


@step()
def running_average(df: DataFrame, column=None, order_by=None, partition_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Mean up to each row."""
    mean = lambda p: F.when(p["n"] > 0, p["s"].cast("double") / p["n"])
    return _running(df, column, order_by, partition_by, name or f"{column}_running_avg", {"s": (F.sum, _plus), "n": (F.count, _plus)}, mean, one_task_bytes)


@step()
def rolling_min(df: DataFrame, column=None, window=3, order_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Least value of a row and those before it."""
    return _rolling(df, column, window, order_by, name or f"{column}_rolling_min", F.min, one_task_bytes)


@step()
def rolling_max(df: DataFrame, column=None, window=3, order_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Largest value of a row and those before it."""
    return _rolling(df, column, window, order_by, name or f"{column}_rolling_max", F.max, one_task_bytes)


@step()
def rolling_sum(df: DataFrame, column=None, window=3, order_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Sum of a row and those before it."""
    return _rolling(df, column, window, order_by, name or f"{column}_rolling_sum", F.sum, one_task_bytes)
