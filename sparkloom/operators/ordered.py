"""Windows over the whole table in one order, without one task for the whole table.

A small input (by Spark's own size estimate) takes a plain window.  A larger one
is range-partitioned by the order, written once to the shared folder, and gets a
dense row index from the partitions' counts.  Blocks of consecutive rows then
stand in for the window's partition: running values add what the blocks before
hold, trailing frames get a halo of the rows before their block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Estimated bytes up to which one task takes the whole order.
ONE_TASK_BYTES = 64 << 20
#: Estimated bytes of one range partition of a larger one.
PART_BYTES = 256 << 20
#: Rows of one block.
BLOCK_ROWS = 1 << 20

INDEX, BLOCK = "__index", "__block"


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size; runs nothing.

    Spark multiplies the sizes of a join's sides, so that an estimate beyond eight
    times all that is scanned is taken for that.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    return min(int(str(plan.stats().sizeInBytes())), 8 * scanned)


def is_small(df: DataFrame, bound: int | None = None) -> bool:
    """Whether the estimated size is within the bound; a plan that explodes rows is taken for a large one, since estimates don't count them."""
    if "Generate " in df._jdf.queryExecution().optimizedPlan().toString():
        return False
    return estimated_bytes(df) <= (ONE_TASK_BYTES if bound is None else bound)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; it goes when the application ends.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not sc.getCheckpointDir():
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/sparkloom/{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def _staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; its partitions' ids then stay as they are."""
    path = scratch(df.sparkSession, "ordered")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_index(df: DataFrame, order: Sequence[Column], name: str = INDEX) -> DataFrame:
    """A dense row number from 0 in ``order``; ties keep the scan's order.

    One range shuffle, one write, one aggregate over the partitions' counts.
    The scan's order is part of the range key, so a value with very many rows
    is dealt to several partitions; their number grows with the input.
    """
    fewest = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # an estimate of a join or of nested columns can be far too high
    parts = max(1, fewest, min(estimated_bytes(df) // PART_BYTES, 100_000))
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    order = [*order, F.col("__tie").asc()]
    ranged = _staged(tied.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    # a row for each range partition
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__start"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return (
        ranged.join(starts, "__part")
        .withColumn(name, F.col("__start") + within.cast("bigint") - 1)
        .drop("__part", "__start", "__tie")
    )


def _asc(within: Sequence[Column]) -> list[Column]:
    return [c.asc() for c in within]


def _window(within: Sequence[Column], order: Sequence[Column]) -> W:
    return W.partitionBy(*within).orderBy(*order) if within else W.orderBy(*order)


def trailing(
    df: DataFrame, order: Sequence[Column], before: int, after: int, value: Callable[[W], Column], name: str,
    *, within: Sequence[Column] = (), one_task_bytes: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``value`` over a window that reaches ``before`` rows back and ``after`` rows on, in each partition of ``within``.

    Partitions of a large table lie one after the other in the one order, so that
    a partition with very many rows is cut into blocks like any table.
    """
    if is_small(df, one_task_bytes):
        return df.withColumn(name, value(_window(within, order)))
    block_rows = max(block_rows, before, after, 1)
    own = with_index(df, [*_asc(within), *order]).withColumn(BLOCK, F.expr(f"{INDEX} div {block_rows}"))
    spot = F.col(INDEX) % block_rows
    blocks = F.array_compact(
        F.array(
            F.col(BLOCK),
            F.when(spot >= block_rows - before, F.col(BLOCK) + 1) if before else F.lit(None).cast("bigint"),
            F.when((spot < after) & (F.col(BLOCK) > 0), F.col(BLOCK) - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    spread = own.withColumn("__home", F.col(BLOCK)).withColumn(BLOCK, F.explode(blocks))
    done = spread.withColumn(name, value(W.partitionBy(BLOCK, *within).orderBy(INDEX)))
    return done.filter(F.col(BLOCK) == F.col("__home")).drop(BLOCK, "__home", INDEX)


def running(
    df: DataFrame,
    order: Sequence[Column],
    partials: dict[str, tuple[Callable[[Column], Column], Column, Callable[[Column, Column], Column]]],
    value: Callable[[dict[str, Column]], Column],
    name: str,
    *,
    within: Sequence[Column] = (),
    one_task_bytes: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``value`` of running aggregates, in each partition of ``within``.

    ``partials``: name -> (aggregate, its input, how the blocks before and the
    block's own part are combined).  Aggregates of none must be null.
    """
    if is_small(df, one_task_bytes):
        w = _window(within, order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, value({k: agg(c).over(w) for k, (agg, c, _) in partials.items()}))
    own = with_index(df, [*_asc(within), *order]).withColumn(BLOCK, F.expr(f"{INDEX} div {block_rows}"))
    own = own.withColumns({f"__by{i}": c for i, c in enumerate(within)})
    by = [f"__by{i}" for i in range(len(within))]
    sums = own.groupBy(BLOCK, *by).agg(*[agg(c).alias(f"__sum_{k}") for k, (agg, c, _) in partials.items()])
    # a row for each block of a partition
    ahead = _window([F.col(c) for c in by], [F.col(BLOCK)]).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        F.col(BLOCK).alias("__block_in"), *[F.col(c).alias(f"{c}_in") for c in by],
        *[agg(F.col(f"__sum_{k}")).over(ahead).alias(f"__in_{k}") for k, (agg, _, _) in partials.items()],
    )
    w = W.partitionBy(BLOCK, *by).orderBy(INDEX).rowsBetween(W.unboundedPreceding, 0)
    same = F.col(BLOCK) == F.col("__block_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_in"))
    both = own.join(carried, same).drop("__block_in", *[f"{c}_in" for c in by])
    parts = {}
    for k, (agg, c, combine) in partials.items():
        inside, before = agg(c).over(w), F.col(f"__in_{k}")
        parts[k] = F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(combine(before, inside))
    done = both.withColumn(name, value(parts))
    return done.drop(BLOCK, INDEX, *by, *[f"__in_{k}" for k in partials])


def ranked(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str], name: str, kind: str,
    *, within: Sequence[str] = (), one_task_bytes: int | None = None,
) -> DataFrame:
    """``rank``, ``dense_rank``, ``percent_rank`` or ``row_number`` over the table, or over each partition of ``within``.

    Ranks of a large table come from its distinct keys and their counts, which
    are joined back; a key with very many rows is split by Spark.
    """
    from ..functions import compat

    parts = [compat.col(c) for c in within]
    if is_small(df, one_task_bytes):
        fn = {"rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "row_number": F.row_number}[kind]
        found = fn().over(_window(parts, order))
        return df.withColumn(name, found if kind == "percent_rank" else found.cast("bigint"))
    if kind == "row_number" and not within:
        return with_index(df, order, name).withColumn(name, F.col(name) + 1)
    if kind == "row_number":
        return running(df, order, {"n": (F.sum, F.lit(1), lambda a, b: a + b)}, lambda p: p["n"].cast("bigint"), name, within=parts, one_task_bytes=one_task_bytes)
    if kind == "percent_rank" and within:
        raise ValueError("percent_rank takes no partition")
    names = list(dict.fromkeys([*within, *keys]))
    mine = [f"__key{i}" for i in range(len(names))]
    distinct = df.groupBy(*[compat.col(k) for k in names]).agg(F.count("*").alias("__n"))
    table = running(
        distinct, order,
        {"n": (F.sum, F.col("__n"), lambda a, b: a + b), "d": (F.sum, F.lit(1), lambda a, b: a + b)},
        lambda p: F.struct((p["n"] - F.col("__n") + 1).alias("rank"), p["d"].alias("dense_rank")),
        "__rank", within=parts, one_task_bytes=one_task_bytes,
    )
    table = table.select(*[compat.col(k).alias(m) for k, m in zip(names, mine)], "__rank")
    same = [compat.col(k).eqNullSafe(F.col(m)) for k, m in zip(names, mine)]
    both = df.join(table, same)
    if kind == "percent_rank":
        total = df.agg(F.count("*").alias("__total"))
        both = both.crossJoin(F.broadcast(total))
        n = F.greatest(F.col("__total") - 1, F.lit(1))
        return both.withColumn(name, (F.col("__rank.rank") - 1) / n).drop("__rank", "__total", *mine)
    return both.withColumn(name, F.col(f"__rank.{kind}").cast("bigint")).drop("__rank", *mine)


def tiled(df: DataFrame, order: Sequence[Column], tiles: int, name: str, *, one_task_bytes: int | None = None) -> DataFrame:
    """NTILE over the whole table."""
    if is_small(df, one_task_bytes):
        return df.withColumn(name, F.ntile(tiles).over(W.orderBy(*order)).cast("bigint"))
    total = df.agg(F.count("*").alias("__total"))
    own = with_index(df, order).crossJoin(F.broadcast(total))
    size, more = F.expr(f"__total div {tiles}"), F.col("__total") % tiles
    edge = more * (size + 1)
    i = F.col(INDEX)
    tile = F.when(i < edge, F.floor(i / (size + 1))).otherwise(more + F.floor((i - edge) / F.greatest(size, F.lit(1))))
    return own.withColumn(name, (tile + 1).cast("bigint")).drop(INDEX, "__total")


def quantiles(df: DataFrame, value: Column, shares: Sequence[float], name: str, *, one_task_bytes: int | None = None) -> DataFrame:
    """One row with the interpolated quantiles of ``value`` as an array.

    Spark's exact percentile holds all distinct values of the table in one
    task.  For a large table the distinct values are counted, and the running
    counts tell which values stand at the wanted places.
    """
    shares = [float(p) for p in shares]
    if is_small(df, one_task_bytes):
        return df.agg(F.percentile(value.cast("double"), F.array(*map(F.lit, shares))).alias(name))
    counts = df.select(value.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    upto = running(
        counts, [F.col("v").asc()], {"s": (F.sum, F.col("n"), lambda a, b: a + b)}, lambda p: p["s"], "upto",
        one_task_bytes=one_task_bytes,
    )
    # one row
    total = F.broadcast(counts.agg((F.sum("n") - 1).alias("last")))
    places = [(F.col("last") * F.lit(p)) for p in shares]
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    cells = [F.struct(at(F.floor(k)).alias("lo"), at(F.ceil(k)).alias("hi"), F.first(k - F.floor(k)).alias("part")) for k in places]
    row = upto.crossJoin(total).agg(F.array(*cells).alias("q"))
    return row.select(
        F.when(F.col("q")[0]["lo"].isNotNull(), F.transform("q", lambda c: c["lo"] + c["part"] * (c["hi"] - c["lo"]))).alias(name)
    )
