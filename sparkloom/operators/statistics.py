"""Statistics as columns.

Values of the whole table come from one aggregate whose single row is joined
to every row; nothing is sorted and no window spans the table.  Values that
depend on an order go through :mod:`.ordered`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aggregates, compat
from . import ordered
from .registry import step


def with_totals(df: DataFrame, totals: dict[str, Column], values: dict[str, Callable[[dict], Column]]) -> DataFrame:
    """Columns computed from each row and the one row of ``totals``."""
    own = {k: f"__total_{k}" for k in totals}
    row = df.agg(*[c.alias(own[k]) for k, c in totals.items()])  # one row
    both = df.crossJoin(F.broadcast(row))
    at = {k: F.col(v) for k, v in own.items()}
    return both.withColumns({name: fn(at) for name, fn in values.items()}).drop(*own.values())


def _number(column: str) -> Column:
    return compat.col(column).cast("double")


def _scalar(df: DataFrame, total: Column, name: str) -> DataFrame:
    return with_totals(df, {"v": total}, {name: lambda t: t["v"]})


def with_quantiles(df: DataFrame, column: str, shares: list, values: dict, one_task_bytes=None) -> DataFrame:
    """Columns computed from each row and the table's quantiles."""
    row = ordered.quantiles(df, compat.col(column), shares, "__q", one_task_bytes=one_task_bytes)  # one row
    both = df.crossJoin(F.broadcast(row))
    return both.withColumns({name: fn(F.col("__q")) for name, fn in values.items()}).drop("__q")


@step()
def percentile(df: DataFrame, column=None, percentile=0.5, name=None, one_task_bytes=None) -> DataFrame:
    """The interpolated percentile of the table."""
    if not column:
        return df
    p = float(percentile)
    return with_quantiles(df, column, [p], {name or f"{column}_p{int(p * 100)}": lambda q: q[0]}, one_task_bytes)


@step()
def quartiles(df: DataFrame, column=None, prefix=None, one_task_bytes=None) -> DataFrame:
    """Three quartiles, each a column."""
    if not column:
        return df
    at = lambda i: lambda q: q[i]
    values = {f"{prefix or column}_q{i + 1}": at(i) for i in range(3)}
    return with_quantiles(df, column, [0.25, 0.5, 0.75], values, one_task_bytes)


@step()
def z_score(df: DataFrame, column=None, name=None) -> DataFrame:
    """Distance from the mean in sample standard deviations; null if all values are equal."""
    if not column:
        return df
    c = _number(column)
    score = lambda t: (c - t["m"]) / F.nullif(t["s"], F.lit(0.0))
    return with_totals(df, {"m": F.avg(c), "s": F.stddev_samp(c)}, {name or f"{column}_zscore": score})


@step()
def normalize(df: DataFrame, column=None, name=None) -> DataFrame:
    """Place between the least and the largest value, from 0 to 1."""
    if not column:
        return df
    c = _number(column)
    place = lambda t: (c - t["lo"]) / F.nullif(t["hi"] - t["lo"], F.lit(0.0))
    return with_totals(df, {"lo": F.min(c), "hi": F.max(c)}, {name or f"{column}_normalized": place})


@step()
def standard_deviation(df: DataFrame, column=None, population=False, name=None) -> DataFrame:
    """Standard deviation of the table."""
    fn = F.stddev_pop if population else F.stddev_samp
    return _scalar(df, fn(_number(column)), name or f"{column}_std") if column else df


@step()
def variance(df: DataFrame, column=None, population=False, name=None) -> DataFrame:
    """Variance of the table."""
    fn = F.var_pop if population else F.var_samp
    return _scalar(df, fn(_number(column)), name or f"{column}_var") if column else df


@step()
def correlation(df: DataFrame, x_column=None, y_column=None, name=None) -> DataFrame:
    """Pearson's correlation of two columns; null below two pairs."""
    if not x_column or not y_column:
        return df
    found = F.nanvl(F.corr(_number(x_column), _number(y_column)), F.lit(None).cast("double"))
    return _scalar(df, found, name or f"corr_{x_column}_{y_column}")


@step()
def covariance(df: DataFrame, x_column=None, y_column=None, population=False, name=None) -> DataFrame:
    """Covariance of two columns."""
    if not x_column or not y_column:
        return df
    fn = F.covar_pop if population else F.covar_samp
    return _scalar(df, fn(_number(x_column), _number(y_column)), name or f"cov_{x_column}_{y_column}")


@step()
def binning(df: DataFrame, column=None, bins=5, method="equal_width", name=None, one_task_bytes=None) -> DataFrame:
    """Bin numbers: of equal width (the largest value is in bin ``bins`` + 1) or of equal frequency."""
    if not column:
        return df
    name, bins = name or f"{column}_bin", int(bins)
    if method == "equal_frequency":
        return ordered.tiled(df, [compat.ordered(column)], bins, name, one_task_bytes=one_task_bytes)
    c = _number(column)
    bucket = lambda t: F.width_bucket(c, t["lo"], t["hi"], F.lit(bins)).cast("bigint")
    return with_totals(df, {"lo": F.min(c), "hi": F.max(c)}, {name: bucket})


@step()
def outlier_detection(df: DataFrame, column=None, multiplier=1.5, name=None, one_task_bytes=None) -> DataFrame:
    """Whether a value lies beyond the quartiles by a multiple of their distance; keeps ``q1`` and ``q3``."""
    if not column:
        return df
    c, m = _number(column), float(multiplier)

    def flag(q: Column) -> Column:
        lo, hi = q[0], q[1]
        return F.coalesce((c < lo - m * (hi - lo)) | (c > hi + m * (hi - lo)), F.lit(False))

    values = {"q1": lambda q: q[0], "q3": lambda q: q[1], name or f"{column}_is_outlier": flag}
    return with_quantiles(df, column, [0.25, 0.75], values, one_task_bytes)


def _rolling(df, column, window, order_by, name, fn, one_task_bytes=None) -> DataFrame:
    if not column or not order_by:
        return df
    n = int(window)
    frame = lambda w: fn(compat.col(column)).over(w.rowsBetween(-(n - 1), 0))
    return ordered.trailing(df, compat.keys(order_by), n - 1, 0, frame, name, one_task_bytes=one_task_bytes)


@step()
def moving_average(df: DataFrame, column=None, window=3, order_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Mean of a row and those before it, ``window`` in all; fewer at the start."""
    return _rolling(df, column, window, order_by, name or f"{column}_ma{window}", F.avg, one_task_bytes)


@step()
def exponential_moving_average(
    df: DataFrame, column=None, alpha=0.3, order_by=None, name=None, one_task_bytes=None
) -> DataFrame:
    """Weighted mean of eleven rows, the weight falling by (1 - alpha) from a row to the next; keeps ``rn``.

    The weights are taken from the frame's first row on, which is the same
    quotient and doesn't run out of precision in a long table.
    """
    if not column or not order_by:
        return df
    decay, keys = 1 - float(alpha), compat.keys(order_by)
    name = name or f"{column}_ema"

    def mean(w: W) -> Column:
        frame = w.rowsBetween(-10, 0)
        values = F.collect_list(F.struct(compat.col(column).cast("double").alias("v"))).over(frame)
        weighed = F.transform(values, lambda x, i: x["v"] * F.pow(F.lit(decay), i))
        weights = F.transform(values, lambda x, i: F.pow(F.lit(decay), i))
        add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
        some = F.exists(values, lambda x: x["v"].isNotNull())
        return F.when(some, add(weighed) / add(weights))

    numbered = ordered.ranked(df, keys, compat.names(order_by) if not isinstance(order_by, dict) else [order_by["column"]], "rn", "row_number", one_task_bytes=one_task_bytes)
    return ordered.trailing(numbered, [F.col("rn").asc()], 10, 0, mean, name, one_task_bytes=one_task_bytes)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def running_sum(df, column, order_by, partition_by, name, one_task_bytes=None) -> DataFrame:
    if not column or not order_by:
        return df
    c = compat.col(column)
    parts = compat.cols(compat.names(partition_by))
    return ordered.running(
        df, compat.keys(order_by), {"s": (F.sum, c, _plus)}, lambda p: p["s"], name, within=parts, one_task_bytes=one_task_bytes
    )


@step()
def cumulative_sum(df: DataFrame, column=None, order_by=None, partition_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Sum up to each row."""
    return running_sum(df, column, order_by, partition_by, name or f"{column}_cumsum", one_task_bytes)


@step()
def cumulative_product(df: DataFrame, column=None, order_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Product up to each row by logarithms: zero from a zero on, NaN from a negative value on."""
    if not column or not order_by:
        return df
    c = _number(column)
    log = F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))
    return ordered.running(
        df, compat.keys(order_by), {"s": (F.sum, log, _plus)}, lambda p: F.exp(p["s"]), name or f"{column}_cumprod",
        one_task_bytes=one_task_bytes,
    )


@step()
def rank_column(
    df: DataFrame, order_by=None, direction="desc", method="rank", partition_by=None, name="rank", one_task_bytes=None
) -> DataFrame:
    """``rank``, ``dense_rank`` or ``row_number``; any other method counts as rank."""
    if not order_by:
        return df
    kind = method if method in ("rank", "dense_rank", "row_number") else "rank"
    keys = compat.keys(order_by, direction)
    parts = compat.names(partition_by)
    return ordered.ranked(df, keys, _key_names(order_by), name, kind, within=parts, one_task_bytes=one_task_bytes)


def _key_names(order_by) -> list[str]:
    items = [order_by] if isinstance(order_by, (str, dict)) else list(order_by)
    return [i if isinstance(i, str) else i["column"] for i in items]


@step()
def percent_rank(df: DataFrame, order_by=None, direction="desc", name=None, one_task_bytes=None) -> DataFrame:
    """Share of the other rows that come before."""
    if not order_by:
        return df
    names = _key_names(order_by)
    return ordered.ranked(
        df, compat.keys(order_by, direction), names, name or f"{names[0]}_pct_rank", "percent_rank", one_task_bytes=one_task_bytes
    )


@step()
def mode(df: DataFrame, column=None, name=None) -> DataFrame:
    """The most frequent value; of several the smallest.

    Values are counted by a group-by, so a column with very many values is no
    map in one task's memory.
    """
    if not column:
        return df
    counts = df.filter(compat.col(column).isNotNull()).groupBy(compat.col(column).alias("v")).agg(F.count("*").alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b")).select(F.col("b.v").alias("__mode"))
    return df.crossJoin(F.broadcast(best)).withColumnRenamed("__mode", name or f"{column}_mode")


@step()
def rolling_std_dev(df: DataFrame, column=None, window=3, order_by=None, name=None, one_task_bytes=None) -> DataFrame:
    """Sample standard deviation of a row and those before it; null for one value."""
    return _rolling(df, column, window, order_by, name or f"{column}_rolling_std", F.stddev_samp, one_task_bytes)


@step()
def simple_linear_regression(df: DataFrame, x_column=None, y_column=None, predict_column=None) -> DataFrame:
    """Least squares of y on x: ``_slope``, ``_intercept`` and the prediction."""
    if not x_column or not y_column:
        return df
    x, y = _number(x_column), _number(y_column)
    return with_totals(
        df,
        {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x)},
        {
            "_slope": lambda t: t["slope"],
            "_intercept": lambda t: t["intercept"],
            predict_column or f"{y_column}_predicted": lambda t: t["slope"] * x + t["intercept"],
        },
    )
