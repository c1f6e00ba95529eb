"""Filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..functions.expr import compile_expr
from . import ordered
from .registry import step


@step()
def filter_rows(df: DataFrame, where=None) -> DataFrame:
    """Rows for which a raw SQL predicate holds."""
    return df.filter(compat.sql(where)) if where else df


@step()
def filter_rows_safe(df: DataFrame, expr=None, allowed_columns=()) -> DataFrame:
    """Rows for which an expression tree holds."""
    return df.filter(compile_expr(expr, allowed_columns)) if expr else df


@step()
def filter_top_percent(df: DataFrame, column=None, percent=10, one_task_bytes=None) -> DataFrame:
    """Rows whose percent rank, from the largest value down, is within ``percent``; keeps ``_pct_rank``."""
    if not column:
        return df
    keys = [compat.ordered(column, "desc")]
    ranked = ordered.ranked(df, keys, [column], "_pct_rank", "percent_rank", one_task_bytes=one_task_bytes)
    return ranked.filter(F.col("_pct_rank") <= float(percent) / 100)


@step()
def filter_by_range(df: DataFrame, column=None, min=None, max=None) -> DataFrame:  # noqa: A002
    """Rows with a value between the bounds, these included."""
    if not column:
        return df
    if min is not None:
        df = df.filter(compat.col(column) >= F.lit(min))
    return df if max is None else df.filter(compat.col(column) <= F.lit(max))
