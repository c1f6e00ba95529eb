"""Table shaping: which columns there are, in what order, under what names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from .registry import step


@step()
def select_columns(df: DataFrame, columns=()) -> DataFrame:
    """The listed columns in their order."""
    return df.select(*compat.cols(columns)) if columns else df


@step()
def drop_columns(df: DataFrame, keep=(), drop=()) -> DataFrame:
    """The columns to keep, or all but those to ``drop``."""
    if keep:
        return df.select(*compat.cols(keep))
    return df.drop(*drop) if drop else df


@step()
def rename_columns(df: DataFrame, mapping=None, columns=(), select=()) -> DataFrame:
    """The listed columns, those in ``mapping`` under new names; unlisted ones go."""
    listed = columns or select
    if not mapping or not listed:
        return df
    return df.select(*[compat.col(c).alias(mapping.get(c, c)) for c in listed])


@step()
def reorder_columns(df: DataFrame, columns=()) -> DataFrame:
    """The listed columns in their order; unlisted ones go."""
    return df.select(*compat.cols(columns)) if columns else df


@step()
def add_constant_column(df: DataFrame, name=None, value=None) -> DataFrame:
    """A column of one literal."""
    return df.withColumn(name, F.lit(value)) if name else df


@step()
def duplicate_column(df: DataFrame, source=None, name=None) -> DataFrame:
    """A copy of a column."""
    return df.withColumn(name, compat.col(source)) if source and name else df


@step()
def move_column(df: DataFrame, column=None, position="last", all_columns=()) -> DataFrame:
    """The column moved to ``first``, ``last`` or ``{"after": other}``; an unknown other counts as last."""
    if not column:
        return df
    rest = [c for c in (all_columns or df.columns) if c != column]
    if position == "first":
        at = 0
    elif position == "last":
        at = len(rest)
    elif isinstance(position, dict) and "after" in position:
        at = rest.index(position["after"]) + 1 if position["after"] in rest else len(rest)
    else:
        raise ValueError(f"unknown position: {position!r}")
    return df.select(*compat.cols([*rest[:at], column, *rest[at:]]))
