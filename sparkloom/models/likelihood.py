"""Maximum likelihood for many groups at a time: a row of sums for each group, Newton steps on the table of groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..operators import ordered
from ..session import share_package
from .passes import number

FAMILIES = ("normal", "lognormal", "exponential", "poisson", "gamma", "weibull", "beta")


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma for positive numbers: by recurrence above 10, then by its series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(10):
        low = x < 10
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(10):
        low = x < 10
        out = np.where(low, out + 1 / (x * x), out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def gamma_shape(mean: np.ndarray, mean_log: np.ndarray) -> np.ndarray:
    """The shape at which log k - digamma k is the log of the mean less the mean of logs; NaN where all values are equal."""
    s = np.log(mean) - mean_log
    s = np.where(s > 1e-14, s, np.nan)
    k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (np.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        k = np.where(k - step > 0, k - step, k / 2)
        if not (np.abs(step) > 1e-13 * k).any():
            break
    return k


def beta_shapes(mean: np.ndarray, var: np.ndarray, mean_log: np.ndarray, mean_log_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both shapes, by Newton's method from those that the moments give; NaN where all values are equal."""
    var = np.where(var > 1e-14, var, np.nan)
    size = np.maximum(mean * (1 - mean) / var - 1, 1e-2)
    a, b = mean * size, (1 - mean) * size
    for _ in range(100):
        both = digamma(a + b)
        f, g = digamma(a) - both - mean_log, digamma(b) - both - mean_log_rest
        t, p, q = trigamma(a + b), trigamma(a), trigamma(b)
        det = (p - t) * (q - t) - t * t
        da, db = ((q - t) * f + t * g) / det, (t * f + (p - t) * g) / det
        cut = np.minimum(1.0, 0.9 / np.maximum(np.maximum(da / a, db / b), 0.9))
        a, b = a - cut * da, b - cut * db
        if not ((np.abs(da) > 1e-13 * a) | (np.abs(db) > 1e-13 * b)).any():
            break
    return a, b


def _log_gamma(x: pd.Series) -> np.ndarray:
    return np.array([math.lgamma(v) if v > 0 else np.nan for v in x])


def fit(df: DataFrame, value: str, family: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, the family's parameters, log_likelihood) of each group.

    Parameters: mean and std (normal), log_mean and log_std (lognormal), rate
    (exponential, poisson), shape and rate (gamma), shape and scale (weibull),
    a and b (beta).  Nulls, NaN and values that the family can't have are left
    out; parameters that the values don't determine (all of a group's are
    equal) are null.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown family: {family}")
    by = list(by)
    x = F.col("x")
    able = {"lognormal": x > 0, "gamma": x > 0, "weibull": x > 0, "beta": (x > 0) & (x < 1), "exponential": x >= 0, "poisson": (x >= 0) & (x == F.floor(x))}
    rows = df.select(*[compat.col(c) for c in by], number(value).alias("x")).filter(x.isNotNull() & ~F.isnan("x") & able.get(family, F.lit(True)))
    group = lambda d, *cells: d.groupBy(*[compat.col(c) for c in by]).agg(*cells)
    keys = [compat.col(c) for c in by]
    n = F.count("x").alias("n")
    share_package(df.sparkSession)
    if family in ("normal", "lognormal"):
        v, prefix = (x, "") if family == "normal" else (F.ln(x), "log_")
        got = group(rows, n, F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.sum(F.lit(0.0) if family == "normal" else v).alias("logs"))
        like = -F.col("n") * (F.ln("s") + 0.5 * math.log(2 * math.pi) + 0.5) - F.col("logs")
        return got.select(*keys, "n", F.col("m").alias(f"{prefix}mean"), F.col("s").alias(f"{prefix}std"), F.when(F.col("s") > 0, like).alias("log_likelihood"))
    if family in ("exponential", "poisson"):
        mean = F.avg("x").alias("m")
        if family == "exponential":
            got = group(rows, n, mean).withColumn("rate", F.when(F.col("m") > 0, 1 / F.col("m")))
            return got.select(*keys, "n", "rate", (F.col("n") * (F.ln("rate") - 1)).alias("log_likelihood"))
        # logs of factorials by value
        counted = group(rows, n, mean)
        each = rows.groupBy(*keys, "x").agg(F.count("*").alias("c"))
        log_factorial = F.pandas_udf(lambda v: pd.Series(_log_gamma(v + 1)), "double")
        logs = group(each, F.sum(F.col("c") * log_factorial("x")).alias("logs"))
        both = _joined(counted, logs, by)
        like = F.when(F.col("m") > 0, F.col("n") * F.col("m") * F.ln("m")).otherwise(0.0) - F.col("n") * F.col("m") - F.col("logs")
        return both.select(*keys, "n", F.col("m").alias("rate"), like.alias("log_likelihood"))
    if family == "gamma":
        got = group(rows, n, F.avg("x").alias("m"), F.avg(F.ln("x")).alias("l"))

        @F.pandas_udf("struct<shape: double, rate: double, log_likelihood: double>")
        def newton(n: pd.Series, m: pd.Series, l: pd.Series) -> pd.DataFrame:  # noqa: E741
            k = gamma_shape(m.to_numpy(float), l.to_numpy(float))
            rate = k / m
            return pd.DataFrame({"shape": k, "rate": rate, "log_likelihood": n * (k * np.log(rate) - _log_gamma(k) + (k - 1) * l - rate * m)})

        return _unpacked(got.withColumn("p", newton("n", "m", "l")), keys, "shape", "rate")
    if family == "beta":
        got = group(rows, n, F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.avg(F.ln("x")).alias("l"), F.avg(F.log1p(-x)).alias("r"))

        @F.pandas_udf("struct<a: double, b: double, log_likelihood: double>")
        def newton(n: pd.Series, m: pd.Series, v: pd.Series, l: pd.Series, r: pd.Series) -> pd.DataFrame:  # noqa: E741
            a, b = beta_shapes(*(c.to_numpy(float) for c in (m, v, l, r)))
            whole = n * (_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + (a - 1) * l + (b - 1) * r)
            return pd.DataFrame({"a": a, "b": b, "log_likelihood": whole})

        return _unpacked(got.withColumn("p", newton("n", "m", "v", "l", "r")), keys, "a", "b")
    return _weibull(df.sparkSession, rows, by)


def _unpacked(got: DataFrame, keys: list, *names: str) -> DataFrame:
    whole = lambda c: F.when(~F.isnan(F.col(f"p.{c}")), F.col(f"p.{c}")).alias(c)
    return got.select(*keys, "n", *[whole(c) for c in (*names, "log_likelihood")])


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return a.crossJoin(b)  # one row each
    renamed = b.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(by)})
    same = [compat.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)]
    return a.join(renamed, same).drop(*[f"__{i}" for i in range(len(by))])


def _weibull(spark, rows: DataFrame, by: list[str], rounds: int = 60) -> DataFrame:
    """A pass for each Newton step over all groups: the sums of x^k, x^k ln x and x^k ln^2 x depend on a group's k.

    Values are taken in units of the group's largest, so that no power overflows.
    The table of groups is written between steps.
    """
    keys = [compat.col(c) for c in by]
    logs = rows.select(*keys, F.ln("x").alias("l"))
    start = logs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("l").alias("mean"), F.max("l").alias("top"), F.stddev_pop("l").alias("s"))
    state = ordered._staged(start.withColumn("k", F.when(F.col("s") > 1e-12, math.pi / math.sqrt(6) / F.col("s"))).withColumn("still", F.col("k").isNull()))
    for _ in range(rounds):
        if not state.filter("not still").limit(1).count():
            break
        open_ = state.filter("not still")
        power = F.exp(F.col("k") * (F.col("l") - F.col("top")))
        u = F.col("l") - F.col("top")
        sums = _joined(logs, open_.select(*keys, "k", "top"), by).groupBy(*keys).agg(F.sum(power).alias("a"), F.sum(power * u).alias("b"), F.sum(power * u * u).alias("c"))
        both = _joined(open_, sums, by)
        f = F.col("b") / F.col("a") - 1 / F.col("k") - (F.col("mean") - F.col("top"))
        slope = F.col("c") / F.col("a") - F.pow(F.col("b") / F.col("a"), 2) + 1 / (F.col("k") * F.col("k"))
        step = f / slope
        new = F.when(F.col("k") - step > 0, F.col("k") - step).otherwise(F.col("k") / 2)
        moved = both.select(*[compat.col(c) for c in state.columns if c not in ("k", "still")], new.alias("k"), (F.abs(new - F.col("k")) <= 1e-12 * F.col("k")).alias("still"))
        state = ordered._staged(moved.unionByName(state.filter("still")))
    power = F.exp(F.col("k") * (F.col("l") - F.col("top")))
    whole = _joined(logs, state, by).groupBy(*keys, "n", "mean", "top", "k").agg(F.avg(power).alias("a"))
    log_scale = F.col("top") + F.ln("a") / F.col("k")
    like = F.col("n") * (F.ln("k") - F.col("k") * log_scale + (F.col("k") - 1) * F.col("mean") - 1)
    return whole.select(*keys, "n", F.col("k").alias("shape"), F.exp(log_scale).alias("scale"), like.alias("log_likelihood"))
