"""A second Parquet scan for files with types that Spark refuses: Arrow reads row groups in tasks."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..session import share_package
from .excel import _system

#: Rows of one batch on its way to Spark.
BATCH_ROWS = 8192


def files(path: str) -> list[str]:
    """The Parquet files at a path, by name; what is hidden is left out."""
    fs, own = _system(path)
    if fs.get_file_info(own).type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(own, recursive=True))
    root = own.rstrip("/")
    names = sorted(f.path[len(root) + 1 :] for f in found if f.is_file)
    return [f"{path.rstrip('/')}/{n}" for n in names if not any(part[0] in "._" for part in n.split("/"))]


def _odd(kind: pa.DataType) -> bool:
    """Whether a type, or one within it, is one that Spark refuses."""
    if pa.types.is_nested(kind):
        return any(_odd(kind.field(i).type) for i in range(kind.num_fields))
    nanos = pa.types.is_timestamp(kind) and kind.unit == "ns"
    return pa.types.is_time(kind) or pa.types.is_float16(kind) or pa.types.is_interval(kind) or nanos


def readable(kind: pa.DataType) -> pa.DataType:
    """What a column of this type comes as: times of day and nested odd types as text."""
    if pa.types.is_dictionary(kind):
        return readable(kind.value_type)
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if pa.types.is_float16(kind):
        return pa.float32()
    if pa.types.is_uint64(kind):
        return pa.decimal128(20, 0)
    if pa.types.is_null(kind):
        return pa.int32()
    if pa.types.is_unsigned_integer(kind):
        return pa.int64()
    if pa.types.is_duration(kind):
        return pa.int64()
    if pa.types.is_fixed_size_binary(kind):
        return pa.binary()
    return pa.string() if _odd(kind) else kind


def cast(column: pa.Array) -> pa.Array:
    kind, wanted = column.type, readable(column.type)
    if kind == wanted:
        return column
    if pa.types.is_time(kind):
        text = pc.cast(column, pa.string())
        return pc.replace_substring_regex(text, r"\.0+$", "")
    if pa.types.is_nested(kind):
        return pa.array([None if v is None else json.dumps(v, default=str) for v in column.to_pylist()], pa.string())
    return pc.cast(column, wanted, safe=False)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The files' columns by the first one's schema; a task takes a row group.  Missing columns of other files are null."""
    share_package(spark)
    own = files(path)
    if not own:
        raise ValueError(f"no Parquet file at {path}")

    def opened(file: str) -> pq.ParquetFile:
        fs, p = _system(file)
        return pq.ParquetFile(fs.open_input_file(p))

    first = opened(own[0]).schema_arrow
    schema = pa.schema([pa.field(f.name, readable(f.type)) for f in first])

    def groups(batches):
        for batch in batches:
            rows = [(f, i) for f in batch.column(0).to_pylist() for i in range(opened(f).num_row_groups)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["file", "part"])

    def read(batches):
        for batch in batches:
            for f, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = opened(f)
                names = [n for n in schema.names if n in source.schema_arrow.names]
                for rows in source.iter_batches(BATCH_ROWS, row_groups=[part], columns=names):
                    columns = [pc.cast(cast(rows.column(n)), schema.field(n).type) if n in names else pa.nulls(rows.num_rows, schema.field(n).type) for n in schema.names]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    listed = spark.createDataFrame([(f,) for f in own], "file string").repartition(min(len(own), 200), "file")
    parts = listed.mapInArrow(groups, "file string, part int").repartition(F.col("file"), F.col("part"))
    return parts.mapInArrow(read, from_arrow_schema(schema))
