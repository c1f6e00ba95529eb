"""Datetime operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from .registry import step


@step()
def date_from_text(df: DataFrame, column=None, format=None, as_=None, strict=True) -> DataFrame:  # noqa: A002
    """A timestamp from text by a strptime format; replaces the column by default."""
    return df.withColumn(as_ or column, compat.strptime(compat.col(column), format, strict=strict)) if column and format else df


@step()
def date_part(df: DataFrame, column=None, part=None, as_=None) -> DataFrame:
    """A part of a date."""
    return df.withColumn(as_ or f"{column}_{part}", compat.date_part(part, compat.col(column))) if column and part else df


@step()
def date_trunc(df: DataFrame, column=None, unit=None, as_=None) -> DataFrame:
    """The start of the unit that a date lies in."""
    return df.withColumn(as_ or f"{column}_{unit}", compat.date_trunc(unit, compat.col(column))) if column and unit else df


@step()
def format_datetime(df: DataFrame, column=None, format=None, as_=None) -> DataFrame:  # noqa: A002
    """Text of a date by a strftime format."""
    return df.withColumn(as_ or f"{column}_fmt", compat.strftime(compat.col(column), format)) if column and format else df


@step()
def date_diff(df: DataFrame, start_column=None, end_column=None, unit="day", name="date_diff") -> DataFrame:
    """Boundaries of the unit between two dates."""
    if not start_column or not end_column:
        return df
    return df.withColumn(name, compat.date_diff(unit, compat.col(start_column), compat.col(end_column)))


@step()
def date_add(df: DataFrame, column=None, value=None, unit="day", name=None) -> DataFrame:
    """A date some units later."""
    return df.withColumn(name or f"{column}_plus", compat.shift(compat.col(column), int(value), unit)) if column and value is not None else df


@step()
def date_subtract(df: DataFrame, column=None, value=None, unit="day", name=None) -> DataFrame:
    """A date some units earlier."""
    return df.withColumn(name or f"{column}_minus", compat.shift(compat.col(column), -int(value), unit)) if column and value is not None else df


@step()
def age_calculation(df: DataFrame, birthdate_column=None, reference_date="CURRENT_DATE", name="age") -> DataFrame:
    """Difference of the calendar years."""
    if not birthdate_column:
        return df
    return df.withColumn(name, compat.date_diff("year", compat.col(birthdate_column), compat.sql(reference_date)))


@step()
def quarter_from_date(df: DataFrame, column=None, name=None) -> DataFrame:
    """Quarter of the year."""
    return df.withColumn(name or f"{column}_quarter", F.quarter(compat.col(column)).cast("bigint")) if column else df


@step()
def week_of_year(df: DataFrame, column=None, name=None) -> DataFrame:
    """ISO week."""
    return df.withColumn(name or f"{column}_week", F.weekofyear(compat.col(column)).cast("bigint")) if column else df
