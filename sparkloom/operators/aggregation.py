"""Aggregation, joins, unions and pivots."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..functions.aggregates import aggregate
from . import counted
from .registry import step


def _grouped(df: DataFrame, group_by, *aggs) -> DataFrame:
    by = compat.names(group_by)
    return df.groupBy(*compat.cols(by)).agg(*aggs) if by else df.agg(*aggs)


@step()
def group_aggregate(df: DataFrame, group_by=(), aggs=()) -> DataFrame:
    """Aggregates {fn, column, as} of groups, or of the table."""
    full = [a for a in aggs if a.get("fn") and a.get("as")]
    if not full:
        return df.select(*compat.cols(group_by)).distinct() if group_by else df
    return counted.grouped(df, compat.names(group_by), [(a["fn"], a.get("column", "*"), a["as"]) for a in full])


@step()
def weighted_average(df: DataFrame, value_column=None, weight_column=None, group_by=(), name="weighted_avg") -> DataFrame:
    """Sum of value times weight over the sum of weights."""
    if not value_column or not weight_column:
        return df
    v, w = compat.col(value_column), compat.col(weight_column)
    return _grouped(df, group_by, compat.divide(F.sum(v * w), F.sum(w)).alias(name))


@step()
def count_distinct(df: DataFrame, column=None, group_by=(), name=None) -> DataFrame:
    """Number of distinct values."""
    if not column:
        return df
    return _grouped(df, group_by, F.count_distinct(compat.col(column)).alias(name or f"{column}_distinct_count"))


@step()
def string_agg(df: DataFrame, column=None, separator=", ", group_by=(), name=None, order_by=None) -> DataFrame:
    """Values of each group joined to a text, in the order of ``order_by`` if it is given."""
    by = compat.names(group_by)
    if not column or not by:
        return df
    name, value = name or f"{column}_concat", compat.col(column).cast("string")
    if not order_by:
        return df.groupBy(*compat.cols(by)).agg(F.listagg(value, F.lit(separator)).alias(name))
    keys = [c if isinstance(c, str) else c["column"] for c in ([order_by] if isinstance(order_by, (str, dict)) else order_by)]
    # nulls aren't listed
    rows = F.collect_list(F.when(value.isNotNull(), F.struct(*[compat.col(k).alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))))
    joined = F.array_join(F.transform(F.sort_array(rows), lambda r: r["v"]), separator)
    return df.groupBy(*compat.cols(by)).agg(F.when(F.size(rows) > 0, joined).alias(name))


JOINS = {
    "inner": "inner", "left": "left", "left outer": "left", "right": "right", "right outer": "right", "full": "full",
    "outer": "full", "full outer": "full", "semi": "left_semi", "left semi": "left_semi", "anti": "left_anti",
    "left anti": "left_anti",
}


def _frame(df: DataFrame, other) -> DataFrame:
    """A DataFrame, or the result of a SQL text or the table of that name."""
    if isinstance(other, DataFrame):
        return other
    spark = df.sparkSession
    return spark.sql(other) if " " in other.strip() else spark.table(other)


@step()
def join(df: DataFrame, right_sql=None, on=(), how="left", select_left=("*",), select_right=()) -> DataFrame:
    """An equi-join; the listed columns of the right side come as ``right_<name>``.

    Spark picks broadcast, sort-merge or hash join by the sides' sizes, and
    splits skewed keys.
    """
    if right_sql is None or not on:
        return df
    kind = str(how).lower().replace("_", " ").removesuffix(" join").strip()
    if kind not in JOINS:
        raise ValueError(f"unknown join: {how}")
    right_only = JOINS[kind] in ("left_semi", "left_anti")
    if right_only and select_right:
        raise ValueError(f"a {how} join has no columns of the right side")
    keys = [o["right"] for o in on]
    wanted = list(dict.fromkeys([*keys, *select_right]))
    other = _frame(df, right_sql)
    other = other.select(*[compat.col(c).alias(f"__right_{i}") for i, c in enumerate(wanted)])
    place = {c: f"__right_{i}" for i, c in enumerate(wanted)}
    same = reduce(operator.and_, [compat.col(o["left"]) == F.col(place[o["right"]]) for o in on])
    joined = df.join(other, same, JOINS[kind])
    left = df.columns if list(select_left) == ["*"] else list(select_left)
    return joined.select(*compat.cols(left), *[F.col(place[c]).alias(f"right_{c}") for c in select_right])


@step()
def union_all(df: DataFrame, other_sql=None, distinct=False) -> DataFrame:
    """Rows of both tables by position, under the names of the first.

    Columns of different kinds meet as text.
    """
    if other_sql is None:
        return df
    other = _frame(df, other_sql)
    if len(df.columns) != len(other.columns):
        raise ValueError("the tables have different numbers of columns")
    text = [
        {a.dataType.simpleString(), b.dataType.simpleString()} & {"string"} and a.dataType != b.dataType
        for a, b in zip(df.schema, other.schema)
    ]
    as_text = lambda d: d.select(*[compat.col(c).cast("string").alias(c) if t else compat.col(c) for c, t in zip(d.columns, text)])
    both = as_text(df).union(as_text(other)) if any(text) else df.union(other)
    return both.distinct() if distinct else both


@step()
def pivot(df: DataFrame, index=(), pivot_col=None, value_col=None, agg_fn="sum", values=()) -> DataFrame:
    """One column for each listed value of ``pivot_col``; one pass, no query for the values."""
    if not pivot_col or not value_col or not values:
        return df
    cell = "__cell"
    cells = [
        aggregate(agg_fn, f"{cell}{i}").alias(str(v)) for i, v in enumerate(values)
    ]
    spread = df.select(
        *compat.cols(compat.names(index)),
        *[
            F.when(compat.col(pivot_col) == F.lit(v), compat.col(value_col)).alias(f"{cell}{i}")
            for i, v in enumerate(values)
        ],
    )
    return _grouped(spread, index, *cells)


@step()
def unpivot(df: DataFrame, id_cols=(), value_cols=(), var_name="attribute", value_name="value") -> DataFrame:
    """A row for each value column, nulls too; one scan."""
    return df.unpivot(list(id_cols), list(value_cols), var_name, value_name) if value_cols else df
