"""Data cleaning."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from .registry import step


def replaced(df: DataFrame, values: dict[str, Column], columns=()) -> DataFrame:
    """The listed columns (all by default), some with new values in their place."""
    return df.select(*[values[c].alias(c) if c in values else compat.col(c) for c in (columns or df.columns)])


@step()
def drop_nulls(df: DataFrame, columns=()) -> DataFrame:
    """Rows without a null in the listed columns; NaN is a value."""
    return df.filter(reduce(operator.and_, [c.isNotNull() for c in compat.cols(columns)])) if columns else df


@step()
def fill_nulls(df: DataFrame, fills=(), columns=()) -> DataFrame:
    """Literals in place of nulls."""
    if not fills:
        return df
    return replaced(df, {f["column"]: F.coalesce(compat.col(f["column"]), F.lit(f["value"])) for f in fills}, columns)


@step()
def replace_values(df: DataFrame, replacements=(), columns=()) -> DataFrame:
    """Values equal to ``old`` become ``new``; the first match of a column counts, and null equals nothing."""
    if not replacements:
        return df
    values: dict[str, Column] = {}
    for name in dict.fromkeys(r["column"] for r in replacements):
        own = [r for r in replacements if r["column"] == name]
        case = reduce(lambda v, r: v.when(compat.col(name) == F.lit(r["old"]), F.lit(r["new"])), own, F)
        values[name] = case.otherwise(compat.col(name))
    return replaced(df, values, columns)


@step()
def change_type(df: DataFrame, conversions=(), columns=()) -> DataFrame:
    """Casts by the dialect's rules; a value that doesn't fit is an error."""
    if not conversions:
        return df
    return replaced(df, {c["column"]: compat.cast(df, compat.col(c["column"]), c["to_type"]) for c in conversions}, columns)


@step()
def coalesce(df: DataFrame, name=None, columns=()) -> DataFrame:
    """The first value that isn't null."""
    return df.withColumn(name, F.coalesce(*compat.cols(columns))) if name and columns else df


@step()
def clean_whitespace(df: DataFrame, columns=(), all_columns=()) -> DataFrame:
    """Runs of white space become one space; none at either end."""
    if not columns:
        return df
    return replaced(df, {c: F.trim(F.regexp_replace(compat.col(c), r"\s+", " ")) for c in columns}, all_columns)
