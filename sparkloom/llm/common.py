"""What the corpus operators share: session set-up, shared tables, text rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a function of batches gets at once; with whole texts in them, batches stay small.
BATCH_ROWS = 256
#: Bytes of one Arrow batch on its way to and from Python, where the session sets none of its own.
BATCH_BYTES = 8 << 20

#: The white space that separates words: space and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep what is under way to them small.

    Spark's own bound is 64 MB a batch, of which a task holds several at a time, outside
    its heap.  A session with a bound of its own keeps it.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(":")
    if root not in known:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, known)])
    environment.setdefault("TOKENIZERS_PARALLELISM", "false")
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; it goes when the application ends.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    path = f"{base.rstrip('/')}/sparkloom/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables written so far; call it once their readers are done."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def stage(df: DataFrame, label: str, *, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    An executor lost later costs a file read, not a new run of what is above.  With
    ``free`` the shuffle files of the write go when it ends, not at some later collection of garbage.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = shared_dir(spark, label), spark.conf.get(cleanup, None)
    if free:
        spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*staged: DataFrame) -> None:
    """Delete tables that :func:`stage` wrote; nothing may read them later."""
    for df in staged:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Project to the named columns under our names, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def free_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix`` with underscores before it until no column begins with it, so that what it names can't clash."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; no decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with small batches, whatever the session's are."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(small, schema)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """:func:`map_arrow` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return map_arrow(df, run, schema)


def record_batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def pieces(total_bytes: int, piece_bytes: int, least: int = 1) -> int:
    """How many partitions of about ``piece_bytes`` hold ``total_bytes``."""
    return max(least, -(-int(total_bytes or 0) // piece_bytes))


def text_size(df: DataFrame, column: str) -> int:
    """Bytes of a text or binary column, counted over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def signed(value: int) -> int:
    """An unsigned 64-bit integer as Spark's signed long."""
    return value - (1 << 64) if value >= 1 << 63 else value


def base32(sha1_hex: Column) -> Column:
    """Bare upper-case base32 of a 40-digit SHA-1 in hexadecimal."""
    groups = [
        F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(
        F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )
