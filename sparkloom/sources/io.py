"""Datasets as Parquet folders: scans, ingest of CSV, Excel and Parquet, exports.

Paths are Hadoop paths, so ``s3a://``, ``hdfs://`` and local ones all do.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat
from . import defensive
from .excel import read_excel, write_excel


class IngestError(ValueError):
    """A file can't be read as a dataset."""


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet scan.  Times of day, and nested times, come as text, since no step reads them.

    Where Spark refuses a type, a second scan reads the files' row groups by
    Arrow and casts such columns: see :mod:`.defensive`.
    """
    try:
        df = spark.read.parquet(path)
    except Exception as first:
        try:
            return defensive.scan(spark, path)
        except Exception as second:
            raise IngestError(f"can't read {path} as Parquet: {first} | second scan: {second}") from first
    odd = [f.name for f in df.schema if type(f.dataType).__name__ in ("TimeType", "DayTimeIntervalType", "YearMonthIntervalType")]
    return df.withColumns({c: compat.col(c).try_cast("string") for c in odd}) if odd else df


@dataclass(frozen=True)
class Dataset:
    """A Parquet folder and its lazily opened frame."""

    spark: SparkSession
    path: str
    name: str = "dataset"

    @cached_property
    def df(self) -> DataFrame:
        return read_parquet(self.spark, self.path)

    @cached_property
    def fingerprint(self) -> str:
        """SHA-256 over the names, sizes and times of the files; no content is read."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files, it = [], fs.listFiles(root, True)
        while it.hasNext():
            s = it.next()
            files.append((s.getPath().getName(), s.getLen(), s.getModificationTime()))
        return hashlib.sha256(json.dumps(sorted(files)).encode()).hexdigest()

    def view(self, name: str | None = None) -> str:
        """Register the frame as a temporary view and return its name."""
        view = (name or f"ds_{self.name}_base").replace("-", "_")
        self.df.createOrReplaceTempView(view)
        return view


def _csv(spark: SparkSession, source: str, multi_line: bool = False) -> DataFrame:
    """A header, then rows; types by all values.  Files are split among tasks, unless quoted values may hold line ends."""
    return spark.read.csv(source, header=True, inferSchema=True, quote='"', escape='"', multiLine=multi_line)


def _excel(spark: SparkSession, source: str, **options) -> DataFrame:
    """The first sheet, or the one asked for."""
    if source.lower().rstrip("/").endswith(".xls"):
        raise IngestError(f"{source} is a binary workbook; save it as .xlsx")
    return read_excel(spark, source, **options)


_READERS = {".csv": _csv, ".xlsx": _excel, ".xls": _excel, ".parquet": read_parquet}


def ingest(spark: SparkSession, source: str, target: str, **options) -> tuple[int, int]:
    """Convert a CSV, Excel or Parquet source to zstd Parquet; returns (rows, columns).

    The rows are counted as they are written.  ``options`` are the reader's: ``multi_line`` for CSV
    whose quoted values hold line ends (a task then takes a file), ``sheet`` and
    ``header`` for workbooks.
    """
    suffix = next((s for s in _READERS if source.lower().rstrip("/").endswith(s)), None)
    if suffix is None:
        raise IngestError(f"unsupported file type: {source}")
    df = _READERS[suffix](spark, source, **options)
    return _counted(df, lambda d: d.write.mode("overwrite").option("compression", "zstd").parquet(target)), len(df.columns)


def _counted(df: DataFrame, write) -> int:
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return int(seen.get["n"])


def export(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write Parquet, CSV with a header, or workbooks; returns the rows, counted on the way."""
    fmt = fmt.lower()
    if fmt == "parquet":
        return _counted(df, lambda d: d.write.mode("overwrite").parquet(path))
    if fmt == "csv":
        flat = df.select(
            *[F.to_json(compat.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else compat.col(f.name) for f in df.schema]
        )
        return _counted(flat, lambda d: d.write.mode("overwrite").csv(path, header=True, quote='"', escape='"'))
    if fmt == "xlsx":
        return _counted(df, lambda d: write_excel(d, path))
    raise ValueError(f"unsupported export format: {fmt}")


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """The first rows."""
    return df.limit(n)


def json_records(df: DataFrame, limit: int | None = 10_000) -> DataFrame:
    """At most ``limit`` rows, or all, as JSON texts in one column ``record``, where they lie; dates are ISO dates, nulls are kept."""
    own = df if limit is None else df.limit(limit)
    return own.select(F.to_json(F.struct(*[compat.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("record"))


def records(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """:func:`json_records` on the driver, as dictionaries."""
    return [json.loads(r["record"]) for r in json_records(df, limit).collect()]
