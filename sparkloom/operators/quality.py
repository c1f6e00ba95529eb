"""Data quality flags and scores."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from .registry import step
from .statistics import with_totals


@step()
def data_validation(df: DataFrame, validations=(), name="is_valid") -> DataFrame:
    """Whether all raw SQL conditions hold; an unknown one doesn't."""
    conditions = [compat.sql(v["condition"]) for v in validations if v.get("condition")]
    if not conditions:
        return df
    return df.withColumn(name, F.coalesce(reduce(operator.and_, conditions), F.lit(False)))


def _counted(df: DataFrame, columns, name: str) -> DataFrame:
    """The number of rows with the same values, from a map-side count joined back; a hot key is split by Spark."""
    keys = [f"__key{i}" for i in range(len(columns))]
    counts = df.groupBy(*[compat.col(c).alias(k) for c, k in zip(columns, keys)]).agg(F.count("*").alias(name))
    same = reduce(operator.and_, [compat.col(c).eqNullSafe(F.col(k)) for c, k in zip(columns, keys)])
    return df.drop(name).join(counts, same).drop(*keys)


@step()
def find_duplicates(df: DataFrame, columns=(), name="is_duplicate") -> DataFrame:
    """Whether another row has the same values; nulls are equal."""
    if not columns:
        return df
    return _counted(df, list(columns), "__n").withColumn(name, F.col("__n") > 1).drop("__n")


@step()
def value_frequency(df: DataFrame, column=None, name=None) -> DataFrame:
    """How many rows have the same value; nulls are a value."""
    return _counted(df, [column], name or f"{column}_frequency") if column else df


@step()
def outlier_flag(df: DataFrame, column=None, threshold=3.0, name=None) -> DataFrame:
    """Whether a value is over ``threshold`` sample standard deviations from the mean."""
    if not column:
        return df
    c = compat.col(column).cast("double")
    flag = lambda t: F.coalesce(F.abs((c - t["m"]) / F.nullif(t["s"], F.lit(0.0))) > float(threshold), F.lit(False))
    return with_totals(df, {"m": F.avg(c), "s": F.stddev_samp(c)}, {name or f"{column}_is_outlier": flag})


@step()
def missing_value_flag(df: DataFrame, columns=(), name="has_missing") -> DataFrame:
    """Whether any of the columns is null."""
    return df.withColumn(name, reduce(operator.or_, [c.isNull() for c in compat.cols(columns)])) if columns else df


@step()
def data_type_check(df: DataFrame, column=None, target_type=None, name=None) -> DataFrame:
    """Whether a value can be cast to the type; a null can't."""
    if not column or not target_type:
        return df
    return df.withColumn(
        name or f"{column}_is_{target_type}", compat.cast(df, compat.col(column), target_type, strict=False).isNotNull()
    )


@step()
def row_quality_score(df: DataFrame, columns=(), name="quality_score") -> DataFrame:
    """Percentage of the columns that aren't null."""
    if not columns:
        return df
    full = reduce(operator.add, [c.isNotNull().cast("double") for c in compat.cols(columns)])
    return df.withColumn(name, full * 100.0 / len(columns))
