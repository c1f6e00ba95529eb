"""Profiles of datasets: one aggregate over all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat


def role(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "categorical"


def profile_frame(df: DataFrame) -> DataFrame:
    """One row for each column: role, type, missing share, and the numbers' summary; one pass."""
    cells, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(df.schema):
        c = compat.col(f.name)
        numeric = role(f.dataType) == "numeric"
        x = c.cast("double") if numeric else F.lit(None).cast("double")
        cells += [
            F.count(c).alias(f"{i}_count"),
            F.avg(x).alias(f"{i}_mean"),
            F.stddev_samp(x).alias(f"{i}_std"),
            F.min(x).alias(f"{i}_min"),
            F.max(x).alias(f"{i}_max"),
        ]
        missing = F.when(F.col("n") > 0, F.round((F.col("n") - F.col(f"{i}_count")) / F.col("n"), 4)).otherwise(0.0)
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(role(f.dataType)).alias("role"),
                F.col("n").alias("rows"),
                missing.alias("missing_pct"),
                *[F.col(f"{i}_{k}").alias(k) for k in ("count", "mean", "std", "min", "max")],
            )
        )
    return df.agg(*cells).select(F.inline(F.array(*rows)))


def profile(df: DataFrame, sample_rows: int = 50) -> dict:
    """The profile as plain data, with the first rows."""
    rows = [r.asDict() for r in profile_frame(df).collect()]
    return {
        "n_rows": rows[0]["rows"] if rows else 0,
        "n_cols": len(rows),
        "schema": [{"name": r["column"], "dtype": r["dtype"], "role": r["role"]} for r in rows],
        "missing_pct": {r["column"]: r["missing_pct"] for r in rows},
        "numeric_summary": {
            r["column"]: {k: r[k] for k in ("count", "mean", "std", "min", "max")} for r in rows if r["role"] == "numeric"
        },
        "sample_rows": [r.asDict(recursive=True) for r in df.limit(sample_rows).collect()],
    }
