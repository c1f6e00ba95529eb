"""Aggregates of groups that come from counted values.

A median or a mode needs all values of a group at once.  Here the values are
counted first, by a group-by with a map-side part; what is left is a row for each
distinct value of a group, and running counts say which stand at the wanted
places.  No group is one task's list or map.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..functions.aggregates import aggregate
from . import ordered, sketches

#: Aggregates by counted values; percentile_N is one too.
COUNTED = ("median", "mode", "mad", "nunique", "count_distinct", "entropy", "histogram")
_PERCENTILE = re.compile(r"percentile_(\d{1,3})")
#: Aggregates by sketches: approx_percentile_N, approx_top_N (values as texts, the most frequent first) and approx_nunique.
_SKETCHED = re.compile(r"approx_(?:(percentile|top)_(\d{1,4})|(nunique))")


def is_counted(fn: str) -> bool:
    name = fn.strip().lower()
    return name in COUNTED or bool(_PERCENTILE.fullmatch(name))


def _by_sketch(df: DataFrame, keys: Sequence[str], column: str, fn: str, name: str) -> DataFrame:
    kind, number, distinct = _SKETCHED.fullmatch(fn).groups()
    if distinct:
        return sketches.distinct_sketch(df, column, keys).select(*keys, sketches.distinct_estimate("sketch").alias(name))
    if kind == "percentile":
        if int(number) > 100:
            raise ValueError("a percentile lies between 0 and 100")
        return sketches.quantile_sketch(df, column, keys).select(*keys, sketches.quantile_estimate("sketch", int(number) / 100).alias(name))
    counters = max(sketches.COUNTERS, 4 * int(number))
    found = sketches.top_estimate("sketch", int(number))
    return sketches.top_sketch(df, column, keys, counters=counters).select(*keys, F.transform(found, lambda e: e["value"]).alias(name))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``, nulls among the keys being equal."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"{k}_r" for k in keys])


def _grouped(df: DataFrame, keys: Sequence[str], *cells: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*cells) if keys else df.agg(*cells)


def _quantiles(counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys and a column for each share): interpolated quantiles from (keys, v, n)."""
    order = [F.col(k).asc() for k in keys]
    upto = ordered.running(counts, [F.col("v").asc()], {"s": (F.sum, F.col("n"), _plus)}, lambda p: p["s"], "upto", within=[F.col(k) for k in keys])
    totals = _grouped(counts, keys, F.sum("n").alias("total"))
    both = _joined(upto, totals, keys)
    cells = []
    for name, p in shares.items():
        k = (F.col("total") - 1) * F.lit(p)
        at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
        cells += [at(F.floor(k)).alias(f"{name}_lo"), at(F.ceil(k)).alias(f"{name}_hi"), F.max(k - F.floor(k)).alias(f"{name}_part")]
    found = _grouped(both, keys, *cells)
    mid = lambda n: F.col(f"{n}_lo") + F.col(f"{n}_part") * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))
    return found.select(*keys, *[mid(n).alias(n) for n in shares])


def _of_column(df: DataFrame, keys: list[str], column: str, wanted: dict[str, str]) -> DataFrame:
    """(keys and ``wanted``: name -> function) over one column."""
    counts = df.filter(compat.col(column).isNotNull()).groupBy(*keys, compat.col(column).alias("v")).agg(F.count("*").alias("n"))
    parts: list[DataFrame] = []
    cells = []
    for name, fn in wanted.items():
        if fn in ("nunique", "count_distinct"):
            cells.append(F.count("*").alias(name))
        elif fn == "mode":
            cells.append(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias(name))
        elif fn == "entropy":
            n = F.sum("n")
            cells.append(F.greatest(F.lit(0.0), F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias(name))
        elif fn == "histogram":  # a map of the group's values is what it is
            cells.append(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(name))
    if cells:
        parts.append(_grouped(counts, keys, *cells))
    numbers = counts.withColumn("v", F.col("v").cast("double"))
    shares = {name: 0.5 if fn == "median" else int(_PERCENTILE.fullmatch(fn)[1]) / 100 for name, fn in wanted.items() if fn == "median" or _PERCENTILE.fullmatch(fn)}
    mads = [name for name, fn in wanted.items() if fn == "mad"]
    if any(p > 1 for p in shares.values()):
        raise ValueError("a percentile lies between 0 and 100")
    if shares or mads:
        parts.append(_quantiles(numbers, keys, shares | ({"__median": 0.5} if mads else {})))
    if mads:
        away = _joined(numbers, parts[-1].select(*keys, "__median"), keys)
        away = away.groupBy(*keys, F.abs(F.col("v") - F.col("__median")).alias("v")).agg(F.sum("n").alias("n"))
        parts[-1] = parts[-1].drop("__median")
        parts.append(_quantiles(away, keys, {name: 0.5 for name in mads}))
    return reduce(lambda a, b: _joined(a, b, keys), [p for p in parts if len(p.columns) > len(keys)])


def grouped(df: DataFrame, by: Sequence[str], aggs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Aggregates (function, column, name) of groups, or of the table, in that order."""
    by, aggs = list(by), [(fn.strip().lower(), column or "*", name) for fn, column, name in aggs]
    sketched = {i: (fn, column) for i, (fn, column, _) in enumerate(aggs) if _SKETCHED.fullmatch(fn)}
    direct = [(fn, column, name) for i, (fn, column, name) in enumerate(aggs) if not is_counted(fn) and i not in sketched]
    counted: dict[str, dict[str, str]] = {}
    for i, (fn, column, _) in enumerate(aggs):
        if is_counted(fn):
            counted.setdefault(column, {})[f"__a{i}"] = fn
    keys = [f"__k{i}" for i in range(len(by))]
    own = df.withColumns({k: compat.col(c) for k, c in zip(keys, by)})
    if not counted and not sketched:
        cells = [aggregate(fn, column).alias(name) for fn, column, name in direct]
        return df.groupBy(*compat.cols(by)).agg(*cells) if by else df.agg(*cells)
    place = {name: f"__a{i}" for i, (_, _, name) in enumerate(aggs)}
    cells = [aggregate(fn, column).alias(place[name]) for fn, column, name in direct] or [F.count(F.lit(1)).alias("__n")]
    out = _grouped(own, keys, *cells)
    for column, wanted in counted.items():
        out = _joined(out, _of_column(own, keys, column, wanted), keys)
    for i, (fn, column) in sketched.items():
        out = _joined(out, _by_sketch(own, keys, column, fn, f"__a{i}"), keys)
    zero = {f"__a{i}" for i, (fn, _, _) in enumerate(aggs) if fn in ("nunique", "count_distinct")}
    value = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) if c in zero else F.col(c)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *[value(f"__a{i}").alias(name) for i, (_, _, name) in enumerate(aggs)])
