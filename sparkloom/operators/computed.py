"""Computed columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..functions.expr import compile_expr
from .registry import step

OPERATIONS = {
    "add": operator.add,
    "subtract": operator.sub,
    "multiply": operator.mul,
    "divide": compat.divide,
    "power": F.pow,
    "modulo": compat.modulo,
}


@step()
def add_computed_column(df: DataFrame, name=None, expr=None) -> DataFrame:
    """A column from a raw SQL expression."""
    return df.withColumn(name, compat.sql(expr)) if name and expr else df


@step()
def add_computed_safe(df: DataFrame, name=None, expr=None, allowed_columns=()) -> DataFrame:
    """A column from an expression tree."""
    return df.withColumn(name, compile_expr(expr, allowed_columns)) if name and expr else df


@step()
def add_conditional_column(df: DataFrame, name=None, conditions=(), else_=None) -> DataFrame:
    """The literal of the first condition that holds."""
    cases = [c for c in conditions if c.get("when") and c.get("then") is not None]
    if not name or not cases:
        return df
    value = reduce(lambda v, c: v.when(compat.sql(c["when"]), F.lit(c["then"])), cases, F)
    return df.withColumn(name, value.otherwise(F.lit(else_)))


@step()
def add_math_column(df: DataFrame, name=None, operation="add", columns=()) -> DataFrame:
    """Two or more columns put together from the left."""
    if not name or len(columns) < 2 or operation not in OPERATIONS:
        return df
    return df.withColumn(name, reduce(OPERATIONS[operation], compat.cols(columns)))
