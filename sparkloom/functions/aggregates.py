"""Aggregate functions by name; those that need all values of a group at once are in ``operators.counted``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import compat


def skewness(c: Column) -> Column:
    """Sample skewness, null below three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c.cast("double")) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: Column) -> Column:
    """Sample excess kurtosis, null below four values."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c.cast("double")) + 6))


def listed(c: Column) -> Column:
    """All values in a list, nulls included."""
    return F.transform(F.collect_list(F.struct(c.alias("v"))), lambda x: x["v"])


def mode(c: Column) -> Column:
    """The most frequent value; of several the smallest."""
    return F.mode(c, True)


def median(c: Column) -> Column:
    return F.median(c.cast("double"))


def quantile(p: float) -> Callable[[Column], Column]:
    return lambda c: F.percentile(c.cast("double"), F.lit(float(p)))


def string_agg(c: Column, separator: str = ",") -> Column:
    return F.listagg(c.cast("string"), F.lit(separator))


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "sum": F.sum,
    "avg": lambda c: F.avg(c).cast("double"),
    "mean": lambda c: F.avg(c).cast("double"),
    "min": F.min,
    "max": F.max,
    "median": median,
    "mode": mode,
    "std": F.stddev_samp,
    "stddev": F.stddev_samp,
    "stddev_samp": F.stddev_samp,
    "stddev_pop": F.stddev_pop,
    "var": F.var_samp,
    "variance": F.var_samp,
    "var_samp": F.var_samp,
    "var_pop": F.var_pop,
    "nunique": F.count_distinct,
    "count_distinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct,
    "first": F.first,
    "last": F.last,
    "any_value": lambda c: F.any_value(c, True),
    "list": listed,
    "array_agg": listed,
    "string_agg": string_agg,
    "product": lambda c: F.product(c.cast("double")),
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
    "skewness": skewness,
    "kurtosis": kurtosis,
    "skewness_pop": F.skewness,
    "kurtosis_pop": F.kurtosis,
}


def aggregate(fn: str, column: str = "*") -> Column:
    """The aggregate ``fn`` over a column; ``percentile_90`` and the like interpolate."""
    name = fn.strip().lower()
    if name == "count" and column in ("*", None, ""):
        return F.count(F.lit(1))
    if m := re.fullmatch(r"percentile_(\d{1,3})", name):
        if int(m[1]) > 100:
            raise ValueError(f"percentile out of range: {fn}")
        return quantile(int(m[1]) / 100)(compat.col(column))
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {fn}")
    return AGGREGATES[name](compat.col(column))
