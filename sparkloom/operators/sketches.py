"""Sketches of a column's values per group: small binary columns that can be kept and merged later.

Three kinds, all made by aggregates with a map-side part and merged by aggregates
over their unpacked entries, so that sketches of days or files give the
sketch of all:

* ``quantile``: counts in buckets whose bounds grow by a constant factor; a
  quantile's estimate is off by at most ``accuracy`` times the value.
* ``distinct``: the longest run of leading zeros of the values' hashes in each of
  4,096 registers; the number of distinct values is off by 1.6 % (one standard error).
* ``top``: counters of the most frequent values less what the next one has; a
  value's count lies between ``low`` and ``high``, which are apart by at most the
  number of values over ``counters`` + 1.

Quantile and distinct sketches don't depend on the order of merges, bit for bit.
Nulls are left out, NaN too where numbers are meant.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import compat

ACCURACY = 0.01
REGISTER_BITS = 12
COUNTERS = 256

#: Added to a bucket's number, so that keys of negative, zero and positive values are in their order.
_MIDDLE = 1 << 20
_INFINITE = 1 << 22
_SHIFT = 1 << 31


def _keys(by: Sequence[str]) -> list[Column]:
    return [compat.col(c).alias(c) for c in by]


def _grouped(df: DataFrame, by: Sequence[str], *cells: Column) -> DataFrame:
    return df.groupBy(*[compat.col(c) for c in by]).agg(*cells) if by else df.agg(*cells)


def _hex(c: Column, digits: int) -> Column:
    return F.lpad(F.hex(c.cast("long")), digits, "0")


def _packed(entries: Column, first: tuple[str, int, int], second: tuple[str, int]) -> Column:
    """Sorted pairs as bytes: (field, hexadecimal digits, what is added) and (field, digits)."""
    (a, wide, add), (b, width) = first, second
    text = F.transform(F.sort_array(entries), lambda e: F.concat(_hex(e[a] + add, wide), _hex(e[b], width)))
    return F.unhex(F.array_join(text, ""))


def _unpacked(sketch: Column, first: tuple[str, int, int], second: tuple[str, int]) -> Column:
    (a, wide, add), (b, width) = first, second
    text, size = F.hex(sketch), wide + width
    number = lambda at, n: F.conv(F.substring(text, at, F.lit(n)), 16, 10).cast("long")
    places = F.sequence(F.lit(0), (F.length(text) / size).cast("int") - 1)
    pair = lambda i: F.struct((number(i * size + 1, wide) - add).alias(a), number(i * size + 1 + wide, width).alias(b))
    none = F.array().cast(f"array<struct<{a}: bigint, {b}: bigint>>")
    return F.when(F.length(text) > 0, F.transform(places, pair)).otherwise(none)


# ---------------------------------------------------------------- quantiles

_BUCKET = ("key", 8, _SHIFT), ("n", 16)


def _growth(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("the accuracy lies between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def _bucket(x: Column, accuracy: float) -> Column:
    own = F.when(F.abs(x) == F.lit(math.inf), F.lit(_INFINITE)).otherwise(F.ceil(F.ln(F.abs(x)) / F.lit(math.log(_growth(accuracy)))) + _MIDDLE)
    return F.when(x == 0, F.lit(0)).when(x > 0, own).otherwise(-own).cast("long")


def _value(key: Column, accuracy: float) -> Column:
    g = _growth(accuracy)
    size = F.when(F.abs(key) == _INFINITE, F.lit(math.inf)).otherwise(F.pow(F.lit(g), F.abs(key) - _MIDDLE) * (2 / (g + 1)))
    return F.when(key == 0, F.lit(0.0)).otherwise(F.signum(key.cast("double")) * size)


def quantile_sketch(df: DataFrame, column: str, by: Sequence[str] = (), *, accuracy: float = ACCURACY, name: str = "sketch") -> DataFrame:
    """(by, sketch) of the numbers of each group."""
    x = compat.col(column).cast("double")
    rows = df.select(*_keys(by), _bucket(x, accuracy).alias("__key"), x.alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    return _kept(rows.groupBy(*[compat.col(c) for c in by], "__key").agg(F.count("*").alias("__n")), by, name)


def merge_quantile_sketches(sketches: DataFrame, by: Sequence[str] = (), *, name: str = "sketch") -> DataFrame:
    """(by, sketch) over all sketches of each group; they must have one accuracy."""
    entries = sketches.select(*_keys(by), F.explode(_unpacked(compat.col(name), *_BUCKET)).alias("e"))
    rows = entries.groupBy(*[compat.col(c) for c in by], F.col("e.key").alias("__key")).agg(F.sum("e.n").alias("__n"))
    return _kept(rows, by, name)


def _kept(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    entries = F.collect_list(F.struct(F.col("__key").alias("key"), F.col("__n").alias("n")))
    return _grouped(rows, by, _packed(entries, *_BUCKET).alias(name))


def quantile_estimate(sketch: str | Column, share: float, *, accuracy: float = ACCURACY) -> Column:
    """About the value that ``share`` of the others are below: the one at floor(share * (n - 1)) in order, from 0; null of nothing."""
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    entries = _unpacked(compat.col(sketch) if isinstance(sketch, str) else sketch, *_BUCKET)
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda s, e: s + e["n"])
    place = F.floor((total - 1) * F.lit(float(share)))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("key"), place.alias("place"))
    step = lambda s, e: F.when(s["seen"] > s["place"], s).otherwise(F.struct((s["seen"] + e["n"]).alias("seen"), e["key"].alias("key"), s["place"].alias("place")))
    return _value(F.aggregate(entries, start, step)["key"], accuracy)


# ---------------------------------------------------------------- distinct values

_REGISTER = ("at", 4, 0), ("zeros", 2)


def distinct_sketch(df: DataFrame, column: str, by: Sequence[str] = (), *, name: str = "sketch") -> DataFrame:
    """(by, sketch) of the distinct values of each group, by 64-bit hashes of the values."""
    h = F.xxhash64(compat.col(column))
    rest = F.shiftleft(h, REGISTER_BITS)
    # the digits of a number in binary, without leading zeros
    zeros = F.when(rest == 0, F.lit(64 - REGISTER_BITS + 1)).otherwise(65 - F.length(F.bin(rest)))
    rows = df.filter(compat.col(column).isNotNull()).select(*_keys(by), F.shiftrightunsigned(h, 64 - REGISTER_BITS).alias("__at"), zeros.alias("__zeros"))
    return _registers(rows, by, name)


def merge_distinct_sketches(sketches: DataFrame, by: Sequence[str] = (), *, name: str = "sketch") -> DataFrame:
    entries = sketches.select(*_keys(by), F.explode(_unpacked(compat.col(name), *_REGISTER)).alias("e"))
    return _registers(entries.select(*_keys(by), F.col("e.at").alias("__at"), F.col("e.zeros").alias("__zeros")), by, name)


def _registers(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    best = rows.groupBy(*[compat.col(c) for c in by], "__at").agg(F.max("__zeros").alias("__zeros"))
    entries = F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__zeros").alias("zeros")))
    return _grouped(best, by, _packed(entries, *_REGISTER).alias(name))


def distinct_estimate(sketch: str | Column) -> Column:
    """About the number of distinct values."""
    entries = _unpacked(compat.col(sketch) if isinstance(sketch, str) else sketch, *_REGISTER)
    m = 1 << REGISTER_BITS
    empty = m - F.size(entries)
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.pow(F.lit(2.0), -e["zeros"])) + empty
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / total
    return F.round(F.when((raw <= 2.5 * m) & (empty > 0), m * F.ln(m / empty)).otherwise(raw)).cast("long")


# ---------------------------------------------------------------- frequent values


def top_sketch(df: DataFrame, column: str, by: Sequence[str] = (), *, counters: int = COUNTERS, name: str = "sketch") -> DataFrame:
    """(by, sketch) of the most frequent values of each group, as texts."""
    value = compat.col(column).cast("string")
    rows = df.filter(value.isNotNull()).groupBy(*_keys(by), value.alias("__v")).agg(F.count("*").alias("__n"))
    return _counters(rows, _grouped(rows, by, F.sum("__n").alias("__total"), F.lit(0).cast("long").alias("__error")), by, counters, name)


def merge_top_sketches(sketches: DataFrame, by: Sequence[str] = (), *, counters: int = COUNTERS, name: str = "sketch") -> DataFrame:
    own = sketches.select(*_keys(by), _summary(compat.col(name)).alias("__s"))
    entries = own.select(*_keys(by), F.explode("__s.items").alias("e"))
    rows = entries.groupBy(*[compat.col(c) for c in by], F.col("e.v").alias("__v")).agg(F.sum("e.n").alias("__n"))
    return _counters(rows, _grouped(own, by, F.sum("__s.total").alias("__total"), F.sum("__s.error").alias("__error")), by, counters, name)


_SUMMARY = "total bigint, error bigint, items array<struct<v: string, n: bigint>>"


def _summary(sketch: Column) -> Column:
    return F.from_json(sketch.cast("string"), _SUMMARY)


def _counters(rows: DataFrame, totals: DataFrame, by: Sequence[str], counters: int, name: str) -> DataFrame:
    """Keep the largest counts less the first that isn't kept.

    The rank's bound reaches the tasks that count, which pass on no more
    rows of a group than that.
    """
    place = F.row_number().over(W.partitionBy(*[compat.col(c) for c in by]).orderBy(F.col("__n").desc(), F.col("__v")))
    most = rows.withColumn("__place", place).filter(F.col("__place") <= counters + 1)
    entry = F.struct((-F.col("__n")).alias("m"), F.col("__v").alias("v"), F.col("__n").alias("n"))
    kept = _grouped(most, by, F.sort_array(F.collect_list(entry)).alias("__items"), F.max(F.when(F.col("__place") == counters + 1, F.col("__n"))).alias("__less"))
    # sums travel as rows of their own, since groups may be null
    both = kept.unionByName(totals, allowMissingColumns=True)
    both = _grouped(both, by, *[F.max(c).alias(c) for c in ("__items", "__less", "__total", "__error")])
    less = F.coalesce("__less", F.lit(0))
    items = F.filter(F.transform(F.coalesce("__items", F.array().cast("array<struct<m: bigint, v: string, n: bigint>>")), lambda e: F.struct(e["v"].alias("v"), (e["n"] - less).alias("n"))), lambda e: e["n"] > 0)
    text = F.to_json(F.struct(F.coalesce("__total", F.lit(0)).alias("total"), (F.coalesce("__error", F.lit(0)) + less).alias("error"), items.alias("items")))
    return both.select(*_keys(by), F.encode(text, "utf-8").alias(name))


def top_estimate(sketch: str | Column, k: int) -> Column:
    """The ``k`` most frequent values as an array of (value, low, high): their counts lie between ``low`` and ``high``."""
    s = _summary(compat.col(sketch) if isinstance(sketch, str) else sketch)
    return F.transform(F.slice(s["items"], 1, k), lambda e: F.struct(e["v"].alias("value"), e["n"].alias("low"), (e["n"] + s["error"]).alias("high")))


def top_error(sketch: str | Column) -> Column:
    """What a value that isn't in the sketch may have at most."""
    return _summary(compat.col(sketch) if isinstance(sketch, str) else sketch)["error"]
