"""Column helpers where the dataset dialect and Spark SQL differ.

The dialect sorts nulls last, divides as doubles, rounds when it casts to an
integer, counts boundaries in date differences, and formats dates by strftime.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ident(name: str) -> str:
    """A column name quoted for Spark SQL; names with a double quote are refused."""
    if not isinstance(name, str) or not name or '"' in name:
        raise ValueError(f"not a column name: {name!r}")
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(ident(name))


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def sql(text: str) -> Column:
    """A raw expression; double quotes mark identifiers, single quotes mark text."""
    parts = re.split(r"('(?:[^']|'')*')", text)
    parts[::2] = [re.sub(r'"([^"]+)"', lambda m: ident(m[1]), p) for p in parts[::2]]
    return F.expr("".join(parts))


def ordered(name: str, direction: str = "asc", nulls: str | None = None) -> Column:
    """A sort key; nulls come last unless ``nulls`` is ``first``."""
    c, down = col(name), str(direction).lower() == "desc"
    if str(nulls or "last").lower() == "first":
        return c.desc_nulls_first() if down else c.asc_nulls_first()
    return c.desc_nulls_last() if down else c.asc_nulls_last()


def keys(order_by: str | Sequence, direction: str = "asc") -> list[Column]:
    """Sort keys of a name, a list of names, or a list of {column, direction, nulls}."""
    items = [order_by] if isinstance(order_by, (str, dict)) else list(order_by or [])
    return [
        ordered(i, direction) if isinstance(i, str) else ordered(i["column"], i.get("direction", "asc"), i.get("nulls"))
        for i in items
    ]


def names(value: str | Sequence[str] | None) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def lit(value: object) -> Column:
    return F.lit(value)


def divide(a: Column, b: Column) -> Column:
    """Division as doubles; by zero it gives an infinity, or NaN for 0 / 0."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of ``a``; null by zero."""
    return F.try_mod(a, b)


def concat(*parts: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


#: Type names of the dialect and Spark's; fixed values.
TYPES = {
    "tinyint": "tinyint", "smallint": "smallint", "integer": "int", "int": "int", "int4": "int", "int8": "bigint",
    "bigint": "bigint", "long": "bigint", "hugeint": "decimal(38,0)", "float": "float", "real": "float", "float4": "float",
    "double": "double", "float8": "double", "varchar": "string", "text": "string", "string": "string", "char": "string",
    "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz",
}
_INTEGERS = {
    "tinyint": 8,
    "smallint": 16,
    "int": 32,
    "bigint": 64,
}


def spark_type(name: str) -> str:
    low = name.strip().lower()
    if m := re.fullmatch(r"(?:decimal|numeric)(?:\s*\((\d+)(?:\s*,\s*(\d+))?\))?", low):
        return f"decimal({m[1] or 18},{m[2] or (0 if m[1] else 3)})"
    low = re.sub(r"\s*\(.*\)$", "", low)
    if low not in TYPES:
        raise ValueError(f"unknown type: {name}")
    return TYPES[low]


def cast(df: DataFrame, c: Column, to: str, *, strict: bool = True) -> Column:
    """Cast by the dialect's rules: halves of doubles go to the even integer, text of numbers is read as a number.

    ``strict`` raises on values that don't fit; otherwise they become null.
    """
    target = spark_type(to)
    source = df.select(c).schema[0].dataType
    as_type = c.cast if strict else c.try_cast
    if target in _INTEGERS and isinstance(source, (T.FloatType, T.DoubleType)):
        return F.rint(c).cast(target) if strict else F.rint(c).try_cast(target)
    if target in _INTEGERS and isinstance(source, T.DecimalType):
        return F.round(c).cast(target) if strict else F.round(c).try_cast(target)
    if target in _INTEGERS and isinstance(source, T.StringType):
        whole = F.trim(c).rlike(r"^[+-]?\d{1,18}$")
        number = F.round(F.trim(c).try_cast("decimal(38,9)"))
        wide = F.rint(F.trim(c).try_cast("double"))
        got = F.when(whole, F.trim(c).try_cast("decimal(38,0)")).otherwise(F.coalesce(number, wide.try_cast("decimal(38,0)")))
        if strict:
            got = F.when(c.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit("not an integer: "), c))).otherwise(got)
            return got.cast(target)
        return got.try_cast(target)
    return as_type(target)


# ---------------------------------------------------------------- dates

_UNITS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century")


def unit(name: str) -> str:
    low = name.strip().lower()
    low = low if low in _UNITS else low.removesuffix("s")
    low = "century" if low == "centurie" else low
    if low not in _UNITS:
        raise ValueError(f"unknown unit of time: {name}")
    return low


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, by arithmetic on its parts."""
    day = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    second = F.hour(c) * 3600 + F.minute(c) * 60
    part = F.extract(F.lit("SECOND"), c)
    return day * 86_400_000_000 + second.cast("bigint") * 1_000_000 + (part * 1_000_000).cast("bigint")


def date_trunc(to: str, c: Column) -> Column:
    u = unit(to)
    if u in ("decade", "century"):
        years = 10 if u == "decade" else 100
        start = F.year(c) - F.pmod(F.year(c) - (0 if u == "decade" else 1), F.lit(years))
        return ntz(F.make_date(start, F.lit(1), F.lit(1)))
    return ntz(F.date_trunc(u, ntz(c)))


def date_diff(to: str, start: Column, end: Column) -> Column:
    """How many boundaries of the unit lie between ``start`` and ``end``; for weeks, spans of seven days."""
    u, a, b = unit(to), ntz(start), ntz(end)
    years = lambda c: F.year(c).cast("bigint")
    if u in ("year", "decade", "century"):
        size = {"year": 1, "decade": 10, "century": 100}[u]
        count = lambda c: F.floor((years(c) - (1 if size == 100 else 0)) / size)
        return (count(b) - count(a)).cast("bigint")
    if u in ("month", "quarter"):
        months = lambda c: years(c) * 12 + F.month(c) - 1
        size = 1 if u == "month" else 3
        return (F.floor(months(b) / size) - F.floor(months(a) / size)).cast("bigint")
    if u == "day":
        return F.datediff(b, a).cast("bigint")
    if u == "week":  # whole weeks, whatever the weekday
        return (F.datediff(b, a) / 7).cast("bigint")
    if u in ("hour", "minute", "second"):  # whole numbers all the way
        count = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour(c)
        for finer, part in (("minute", F.minute), ("second", F.second)):
            if u == "hour" or (u, finer) == ("minute", "second"):
                break
            count = lambda c, larger=count, part=part: larger(c) * 60 + part(c)
        return count(b) - count(a)
    size = {"millisecond": 1000, "microsecond": 1}[u]
    return (F.floor(micros(b) / size) - F.floor(micros(a) / size)).cast("bigint")


def shift(c: Column, value: int, to: str) -> Column:
    """A timestamp ``value`` units later; dates become timestamps."""
    u = unit(to)
    n = int(value)
    months = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200}
    if u in months:
        return ntz(c) + F.make_ym_interval(F.lit(0), F.lit(n * months[u]))
    if u in ("day", "week"):
        return ntz(c) + F.make_dt_interval(F.lit(n * (7 if u == "week" else 1)))
    seconds = {"hour": 3600, "minute": 60, "second": 1, "millisecond": 1e-3, "microsecond": 1e-6}[u]
    return ntz(c) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n * seconds).cast("decimal(18,6)"))


def date_part(part: str, c: Column) -> Column:
    p, long = part.strip().lower(), lambda x: x.cast("bigint")
    if p in ("dow", "dayofweek", "weekday"):
        return long(F.dayofweek(c) - 1)
    if p == "isodow":
        return long(F.weekday(c) + 1)
    if p == "epoch":
        return micros(ntz(c)) / F.lit(1e6)
    if p in ("second", "seconds"):
        return long(F.second(c))
    if p in ("millisecond", "milliseconds"):
        return long(F.pmod(micros(ntz(c)), F.lit(60_000_000)) / 1000)
    if p in ("microsecond", "microseconds"):
        return long(F.pmod(micros(ntz(c)), F.lit(60_000_000)))
    if p in ("week", "weekofyear"):
        return long(F.weekofyear(c))
    if p in ("doy", "dayofyear"):
        return long(F.dayofyear(c))
    if p == "isoyear":
        return long(F.extract(F.lit("YEAROFWEEK"), c))
    if p == "decade":
        return long(F.floor(F.year(c) / 10))
    if p == "century":
        return long(F.floor((F.year(c) - 1) / 100) + 1)
    simple = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute}
    if p.removesuffix("s") not in simple:
        raise ValueError(f"unknown part of a date: {part}")
    return long(simple[p.removesuffix("s")](c))


#: strftime directives and Java date patterns; fixed values.
_PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD",
    "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE", "f": "SSSSSS", "g": "SSS", "F": "yyyy-MM-dd",
    "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "-d": "d", "-m": "M", "-H": "H", "-I": "h", "-M": "m", "-S": "s", "-j": "D",
}
_DIRECTIVE = re.compile(r"%(-?[A-Za-z%])")


def strftime(c: Column, fmt: str) -> Column:
    """Text of a timestamp; directives without a Java pattern are composed."""
    parts: list[Column] = []
    for i, piece in enumerate(_DIRECTIVE.split(fmt)):
        if i % 2 == 0:
            parts += [F.lit(piece)] if piece else []
        elif piece == "%":
            parts.append(F.lit("%"))
        elif piece == "w":
            parts.append((F.dayofweek(c) - 1).cast("string"))
        elif piece == "u":
            parts.append((F.weekday(c) + 1).cast("string"))
        elif piece == "U":  # weeks from the first Sunday
            parts.append(F.lpad(F.floor((F.dayofyear(c) + 6 - (F.dayofweek(c) - 1)) / 7).cast("string"), 2, "0"))
        elif piece == "W":  # weeks from the first Monday
            parts.append(F.lpad(F.floor((F.dayofyear(c) + 6 - F.weekday(c)) / 7).cast("string"), 2, "0"))
        elif piece == "V":
            parts.append(F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
        elif piece == "G":
            parts.append(F.extract(F.lit("YEAROFWEEK"), c).cast("string"))
        elif piece in _PATTERNS:
            parts.append(F.date_format(ntz(c), _PATTERNS[piece]))
        else:
            raise ValueError(f"unknown directive %{piece}")
    return F.concat(*parts) if parts else F.when(c.isNotNull(), "")


def strptime(c: Column, fmt: str, *, strict: bool = True) -> Column:
    """A timestamp from text; bad text raises, or is null if not ``strict``."""
    pattern = ""
    for i, piece in enumerate(_DIRECTIVE.split(fmt)):
        if i % 2 == 0:
            pattern += re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", piece.replace("'", "''"))
        elif piece == "%":
            pattern += "%"
        elif piece in _PATTERNS:
            pattern += {"MM": "M", "dd": "d", "HH": "H", "hh": "h", "mm": "m", "ss": "s", "DDD": "D"}.get(
                _PATTERNS[piece], _PATTERNS[piece]
            )
        else:
            raise ValueError(f"unknown directive %{piece}")
    read = F.to_timestamp_ntz if strict else F.try_to_timestamp
    found = ntz(read(c, F.lit(pattern)))
    if "%y" in fmt:  # two digits from 69 on are of the century before
        found = F.when(F.year(found) >= 2069, found - F.make_ym_interval(F.lit(100))).otherwise(found)
    return found


def like(c: Column, pattern: Column | str) -> Column:
    """LIKE without an escape character."""
    text = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return F.like(c, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def ilike(c: Column, pattern: Column | str) -> Column:
    text = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return F.ilike(c, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]
