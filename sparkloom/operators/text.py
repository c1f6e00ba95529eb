"""Text operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from .cleaning import replaced
from .registry import step


def _in_place(df: DataFrame, fn, columns, all_columns) -> DataFrame:
    return replaced(df, {c: fn(compat.col(c)) for c in columns}, all_columns) if columns else df


@step()
def text_trim(df: DataFrame, columns=(), all_columns=()) -> DataFrame:
    """No spaces at either end."""
    return _in_place(df, F.trim, columns, all_columns)


@step()
def text_lower(df: DataFrame, columns=(), all_columns=()) -> DataFrame:
    """Lower case."""
    return _in_place(df, F.lower, columns, all_columns)


@step()
def text_upper(df: DataFrame, columns=(), all_columns=()) -> DataFrame:
    """Upper case."""
    return _in_place(df, F.upper, columns, all_columns)


@step()
def text_replace(df: DataFrame, replacements=(), columns=()) -> DataFrame:
    """Literal replacements, one after the other."""
    if not replacements:
        return df
    values = {}
    for r in replacements:
        before = values.get(r["column"], compat.col(r["column"]))
        values[r["column"]] = F.replace(before, F.lit(r["old"]), F.lit(r.get("new") or ""))
    return replaced(df, values, columns)


@step()
def text_split(df: DataFrame, column=None, sep=None, parts=2, prefix=None) -> DataFrame:
    """The first parts between separators; a part that isn't there is empty."""
    if not column or not sep:
        return df
    names = [f"{prefix or column + '_part'}{i}" for i in range(1, int(parts) + 1)]
    return df.withColumns(
        {n: F.split_part(compat.col(column), F.lit(sep), F.lit(i)) for i, n in enumerate(names, 1)}
    )


@step()
def text_merge(df: DataFrame, columns_in=(), sep="", name=None) -> DataFrame:
    """Values as text with separators between; a null is empty text."""
    if not columns_in or not name:
        return df
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in compat.cols(columns_in)]
    return df.withColumn(name, F.concat_ws(sep, *parts))


@step()
def text_length(df: DataFrame, column=None, name=None) -> DataFrame:
    """Number of characters."""
    return df.withColumn(name or f"{column}_length", F.length(compat.col(column)).cast("bigint")) if column else df


@step()
def text_substring(df: DataFrame, column=None, start=1, length=None, name=None) -> DataFrame:
    """Characters from ``start`` (1 is the first); position 0 takes one of the length."""
    if not column:
        return df
    start = int(start)
    if start == 0 and length is not None:
        length = max(0, int(length) - 1)
    at = F.lit(start or 1)
    size = F.length(compat.col(column)) if length is None else F.lit(int(length))
    return df.withColumn(name or f"{column}_sub", F.substr(compat.col(column), at, size))


@step()
def text_pad(df: DataFrame, column=None, length=None, side="left", char=" ", name=None) -> DataFrame:
    """Padded to a length; longer text is cut."""
    if not column or length is None:
        return df
    if not char:
        raise ValueError("text_pad needs a character to pad with")
    pad = F.lpad if side == "left" else F.rpad
    return df.withColumn(name or f"{column}_padded", pad(compat.col(column), int(length), char))


def _matches(df: DataFrame, column, text, before: str, after: str, plain: str, name: str) -> DataFrame:
    """A LIKE match; without wildcards in the text, the plain match that a scan can use."""
    if not column or text is None:
        return df
    c = compat.col(column)
    wild = "%" in text or "_" in text
    return df.withColumn(name, compat.like(c, f"{before}{text}{after}") if wild else getattr(c, plain)(text))


@step()
def text_contains(df: DataFrame, column=None, pattern=None, name=None) -> DataFrame:
    """Whether the pattern occurs; ``%`` and ``_`` are wildcards."""
    return _matches(df, column, pattern, "%", "%", "contains", name or f"{column}_contains")


@step()
def text_starts_with(df: DataFrame, column=None, prefix=None, name=None) -> DataFrame:
    """Whether the text starts with the prefix; ``%`` and ``_`` are wildcards."""
    return _matches(df, column, prefix, "", "%", "startswith", name or f"{column}_starts")


@step()
def text_ends_with(df: DataFrame, column=None, suffix=None, name=None) -> DataFrame:
    """Whether the text ends with the suffix; ``%`` and ``_`` are wildcards."""
    return _matches(df, column, suffix, "%", "", "endswith", name or f"{column}_ends")
