"""Feature engineering: numbers for a model from columns of every kind."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat
from .passes import number


def engineered(df: DataFrame, columns, top: int = 5) -> DataFrame:
    """``df`` with features of the columns, by their types.

    Numbers: ``_z`` (standardised, 0 where missing) and ``_log`` (sign times log of
    1 + size).  Dates and times: ``_year``, ``_month``, ``_weekday`` (Monday is 1) and ``_hour``.
    Texts: ``_length`` and a 0/1 column ``_is_VALUE`` for each of the ``top`` most frequent values (of equally
    frequent ones the first in order), other characters than letters and digits
    being underscores.  Booleans: ``_flag``.  Every column: ``_missing``.  One aggregate over numbers and one
    count by text value; NaN counts as missing.
    """
    names = compat.names(columns)
    kinds = {c: df.schema[c].dataType for c in names}
    numbers = [c for c in names if isinstance(kinds[c], T.NumericType)]
    texts = [c for c in names if isinstance(kinds[c], T.StringType)]
    clean = {c: F.when(~F.isnan(number(c)), number(c)) for c in numbers}
    stats = {}
    if numbers:
        row = df.agg(*[f(clean[c]).alias(f"{k}{i}") for i, c in enumerate(numbers) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        stats = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(numbers)}
    values: dict[str, list[str]] = {c: [] for c in texts}
    for c in texts:
        counted = df.filter(compat.col(c).isNotNull()).groupBy(compat.col(c).alias("v")).agg(F.count("*").alias("n"))
        values[c] = [r["v"] for r in counted.orderBy(F.desc("n"), "v").limit(top).collect()]
    out = {}
    for c in names:
        own = compat.col(c)
        missing = own.isNull()
        if c in numbers:
            x, (mean, std) = clean[c], stats[c]
            missing = x.isNull()
            out[f"{c}_z"] = F.coalesce((x - F.lit(mean)) / F.lit(std), F.lit(0.0)) if std else F.lit(0.0)
            out[f"{c}_log"] = F.signum(x) * F.log1p(F.abs(x))
        elif isinstance(kinds[c], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out |= {f"{c}_year": F.year(own), f"{c}_month": F.month(own), f"{c}_weekday": F.weekday(own) + 1}
            if not isinstance(kinds[c], T.DateType):
                out[f"{c}_hour"] = F.hour(own)
        elif c in texts:
            out[f"{c}_length"] = F.length(own)
            for v in values[c]:
                out[f"{c}_is_{re.sub(r'[^0-9A-Za-z]', '_', v)}"] = F.coalesce((own == F.lit(v)).cast("int"), F.lit(0))
        elif isinstance(kinds[c], T.BooleanType):
            out[f"{c}_flag"] = own.cast("int")
        out[f"{c}_missing"] = missing.cast("int")
    return df.withColumns(out)
