"""The statistical analyses.

Each takes a DataFrame and parameters and returns either a dictionary of
numbers, computed from one or two aggregates, or a DataFrame where a result has
a row for each input row.
"""

from __future__ import annotations

import json
import math
import operator
from collections import OrderedDict
from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..operators import ordered
from ..session import share_package
from . import distributions as D
from . import ranks

ANALYSES: dict[str, Callable] = {}


def analysis(*names: str):
    def add(fn):
        for n in names:
            ANALYSES[n] = fn
        return fn

    return add


def _x(column: str) -> Column:
    return compat.col(column).cast("double")


def _need(condition: bool, what: str) -> None:
    if not condition:
        raise ValueError(what)


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(operator.and_, [compat.col(c).isNotNull() for c in columns]))


def _row(df: DataFrame, **cells: Column) -> dict:
    return df.agg(*[c.alias(k) for k, c in cells.items()]).first().asDict()


def _quantiles(df: DataFrame, column: Column, *shares: float) -> list:
    """Interpolated quantiles; nulls where there are no values."""
    return ordered.quantiles(df, column, shares, "q").first()["q"] or [None] * len(shares)


# ---------------------------------------------------------------- descriptions


@analysis("descriptives", "descriptive-statistics", "summary-statistics", "standard-deviation", "mean")
def descriptives(df: DataFrame, columns=None, column=None) -> dict:
    """Twelve numbers for each column: one pass for the moments, one a column for the quantiles."""
    columns = compat.names(columns or column) or compat.numeric_columns(df)
    if not columns:
        return {}
    shares = (0.1, 0.25, 0.5, 0.75, 0.9)
    cells: dict[str, Column] = {"total": F.count(F.lit(1))}
    for i, c in enumerate(columns):
        x = _x(c)
        cells |= {f"{i}_used": F.count(x), f"{i}_mean": F.avg(x), f"{i}_std": F.stddev_samp(x), f"{i}_min": F.min(x), f"{i}_max": F.max(x)}
    r = _row(df, **cells)
    out = {}
    for i, c in enumerate(columns):
        p10, q1, median, q3, p90 = _quantiles(df, _x(c), *shares)
        out[c] = {
            "rows_total": r["total"], "rows_used": r[f"{i}_used"], "rows_missing": r["total"] - r[f"{i}_used"],
            "mean": r[f"{i}_mean"], "std": r[f"{i}_std"], "min": r[f"{i}_min"], "q1": q1, "median": median, "q3": q3,
            "max": r[f"{i}_max"], "p10": p10, "p90": p90,
        }
    return out


@analysis("detailed_descriptives", "median", "quartiles")
def detailed_descriptives(df: DataFrame, column: str) -> dict:
    """Moments and quartiles; skewness and excess kurtosis of the population."""
    x = _x(column)
    r = _row(df, count=F.count(x), mean=F.avg(x), std=F.stddev_samp(x), min=F.min(x), max=F.max(x), skewness=F.skewness(x), kurtosis=F.kurtosis(x))
    q = _quantiles(df, x, 0.25, 0.5, 0.75)
    return r | {"q1": q[0], "median": q[1], "q3": q[2]}


# ---------------------------------------------------------------- correlation


def _r_p(r: float, n: int) -> float:
    if n < 3 or r is None or math.isnan(r):
        return math.nan
    return D.t_two_sided(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2) if abs(r) < 1 else 0.0


def _kendall(df: DataFrame, x: str, y: str) -> tuple[float, float, int]:
    """tau-b, two-sided p by the normal approximation, n."""
    pairs = df.select(_x(x).alias("x"), _x(y).alias("y")).dropna()

    def ties(*by: str) -> tuple[int, int, int, int]:
        t = F.col("count").cast("decimal(38,0)")
        r = pairs.groupBy(*by).count().agg(
            F.sum(t * (t - 1) / 2), F.sum(t * (t - 1) * (2 * t + 5)), F.sum(t * (t - 1) * (t - 2)), F.sum(t)
        ).first()
        return tuple(int(v or 0) for v in r)

    (tx, vx, wx, n), (ty, vy, wy, _), (txy, *_) = ties("x"), ties("y"), ties("x", "y")
    _need(n >= 3, "three complete pairs are needed")
    total = n * (n - 1) // 2
    swaps = ranks.discordant_pairs(pairs)
    s = total - tx - ty + txy - 2 * swaps
    tau = s / math.sqrt((total - tx) * (total - ty)) if total > tx and total > ty else math.nan
    variance = (n * (n - 1) * (2 * n + 5) - vx - vy) / 18 + 2 * tx * ty / (n * (n - 1)) + wx * wy / (9 * n * (n - 1) * (n - 2))
    return tau, 2 * D.normal_sf(abs(s) / math.sqrt(variance)) if variance > 0 else math.nan, n


@analysis("correlation", "pearson-correlation")
def correlation(df: DataFrame, x: str, y: str, method: str = "pearson") -> dict:
    """Correlation of the complete pairs, at least three."""
    if method == "kendall":
        r, p, n = _kendall(df, x, y)
        return {"method": method, "correlation": r, "p_value": p, "n": n}
    _need(method in ("pearson", "spearman"), f"unknown method: {method}")
    pairs = df.select(_x(x).alias("rx"), _x(y).alias("ry")).dropna() if method == "pearson" else ranks.ranked_pairs(df, x, y)
    got = _row(pairs, r=F.corr("rx", "ry"), n=F.count(F.lit(1)))
    _need(got["n"] >= 3, "three complete pairs are needed")
    return {"method": method, "correlation": got["r"], "p_value": _r_p(got["r"], got["n"]), "n": got["n"]}


@analysis("spearman-correlation")
def spearman(df: DataFrame, x: str, y: str) -> dict:
    return correlation(df, x, y, "spearman")


@analysis("correlation_matrix")
def correlation_matrix(df: DataFrame, columns=None, method: str = "pearson") -> dict:
    """Correlations of the rows complete in all columns; one pass for Pearson."""
    columns = compat.names(columns) or compat.numeric_columns(df)
    rows = _complete(df, columns).select(*[_x(c).alias(c) for c in columns])
    if method == "pearson":
        cells = {f"{i}_{j}": F.corr(compat.col(a), compat.col(b)) for (i, a), (j, b) in combinations(enumerate(columns), 2)}
        r = _row(rows, n=F.count(F.lit(1)), **cells)
        n = r["n"]
    else:
        n, r = rows.count(), {}
        for (i, a), (j, b) in combinations(enumerate(columns), 2):
            r[f"{i}_{j}"] = correlation(rows, a, b, method)["correlation"]
    _need(n >= 3, "three complete rows are needed")
    cell = lambda i, j: 1.0 if i == j else r[f"{min(i, j)}_{max(i, j)}"]
    return {"n": n, "matrix": {a: {b: cell(i, j) for j, b in enumerate(columns)} for i, a in enumerate(columns)}}


# ---------------------------------------------------------------- tests of means


@analysis("ttest_1samp", "one-sample-t-test")
def ttest_1samp(df: DataFrame, column: str, popmean: float = 0.0) -> dict:
    x = _x(column)
    r = _row(df, n=F.count(x), mean=F.avg(x), std=F.stddev_samp(x))
    _need(r["n"] >= 2, "two values are needed")
    t = (r["mean"] - popmean) / (r["std"] / math.sqrt(r["n"])) if r["std"] else math.nan
    return {"t_statistic": t, "p_value": D.t_two_sided(t, r["n"] - 1), "mean": r["mean"], "n": r["n"], "popmean": float(popmean)}


@analysis("ttest_2samp", "two-sample-t-test", "ttest")
def ttest_2samp(df: DataFrame, column1: str, column2: str) -> dict:
    """Welch's test of two columns over the rows complete in both."""
    a, b = _x(column1), _x(column2)
    r = _row(_complete(df, [column1, column2]), n=F.count(F.lit(1)), m1=F.avg(a), m2=F.avg(b), v1=F.var_samp(a), v2=F.var_samp(b))
    n = r["n"]
    _need(n >= 2, "two complete rows are needed")
    e1, e2 = r["v1"] / n, r["v2"] / n
    t = (r["m1"] - r["m2"]) / math.sqrt(e1 + e2) if e1 + e2 else math.nan
    dof = (e1 + e2) ** 2 / ((e1**2 + e2**2) / (n - 1)) if e1 + e2 else math.nan
    return {"t_statistic": t, "p_value": D.t_two_sided(t, dof), "df": dof, "mean1": r["m1"], "mean2": r["m2"], "n1": n, "n2": n}


@analysis("paired_ttest", "paired-t-test")
def paired_ttest(df: DataFrame, before: str, after: str) -> dict:
    """t of before minus after; ``mean_difference`` is after minus before."""
    d = _x(before) - _x(after)
    r = _row(df, n=F.count(d), mean=F.avg(d), std=F.stddev_samp(d))
    _need(r["n"] >= 2, "two complete rows are needed")
    t = r["mean"] / (r["std"] / math.sqrt(r["n"])) if r["std"] else math.nan
    return {"t_statistic": t, "p_value": D.t_two_sided(t, r["n"] - 1), "mean_difference": -r["mean"], "n": r["n"]}


@analysis("anova_oneway", "one-way-anova", "anova-one-way", "anova")
def anova_oneway(df: DataFrame, value: str, group: str) -> dict:
    """One-way analysis of variance from the groups' counts, means and deviations.

    ``groups`` is a DataFrame (group, mean, std, n) with a row for every group.
    """
    x = _x(value)
    moments = _complete(df, [value, group]).groupBy(compat.col(group).alias("g")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), (F.var_pop(x) * F.count(x)).alias("ss"))
    total = _row(moments, k=F.count(F.lit(1)), n=F.sum("n"), sum=F.sum(F.col("n") * F.col("m")), within=F.sum("ss"))
    _need(total["k"] >= 2, "two groups are needed")
    grand, n, k = total["sum"] / total["n"], total["n"], total["k"]
    between = _row(moments, b=F.sum(F.col("n") * (F.col("m") - grand) ** 2))["b"]
    f = (between / (k - 1)) / (total["within"] / (n - k)) if n > k and total["within"] else math.inf
    groups = moments.select(F.col("g").alias("group"), F.col("m").alias("mean"), F.col("s").alias("std"), "n")
    return {"f_statistic": f, "p_value": D.f_sf(f, k - 1, n - k), "df_between": k - 1, "df_within": n - k, "groups": groups}


# ---------------------------------------------------------------- chi-square


@analysis("chi_square_goodness")
def chi_square_goodness(df: DataFrame, observed: str, expected: str | None = None) -> dict:
    """Rows hold observed counts, against a column of expected ones or a uniform expectation."""
    o = _x(observed)
    rows = _complete(df, [observed, *([expected] if expected else [])])
    if expected:
        e = _x(expected)
        r = _row(rows, n=F.count(o), chi2=F.sum((o - e) * (o - e) / e))
    else:
        r = _row(rows, n=F.count(o), s=F.sum(o), q=F.sum(o * o))
        r["chi2"] = r["q"] / (r["s"] / r["n"]) - r["s"] if r["n"] and r["s"] else math.nan
    _need(r["n"] >= 2, "two categories are needed")
    return {"chi2_statistic": r["chi2"], "p_value": D.chi2_sf(r["chi2"], r["n"] - 1), "df": r["n"] - 1, "n_categories": r["n"]}


@analysis("chi_square_independence", "chi-square-test")
def chi_square_independence(df: DataFrame, column1: str, column2: str) -> dict:
    """Independence of two columns; continuity correction for one degree of freedom."""
    cells = _complete(df, [column1, column2]).groupBy(compat.col(column1).alias("a"), compat.col(column2).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("rb"))
    size = _row(rows, r=F.count(F.lit(1)), n=F.sum("ra"))
    c, n, r = cols.count(), size["n"] or 0, size["r"]
    _need(r >= 2 and c >= 2, "two categories of each column are needed")
    expected = F.col("ra") * F.col("rb") / F.lit(float(n))
    joined = cells.join(rows, "a").join(cols, "b")
    if (r - 1) * (c - 1) == 1:  # absent cells count too
        full = rows.crossJoin(F.broadcast(cols)).join(cells, ["a", "b"], "left").fillna({"o": 0})
        gap = F.abs(F.col("o") - expected)
        chi2 = _row(full, x=F.sum(F.pow(gap - F.least(F.lit(0.5), gap), 2) / expected))["x"]
    else:  # the sum over all cells of (o - e)^2 / e is that of o^2 / e less n
        chi2 = _row(joined, x=F.sum(F.col("o") * F.col("o") / expected))["x"] - n
    dof = (r - 1) * (c - 1)
    return {"chi2_statistic": chi2, "p_value": D.chi2_sf(chi2, dof), "df": dof, "n": n}


# ---------------------------------------------------------------- ranks


def _exact_ranksum(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties, by counting all arrangements."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1
    for i in range(1, n2 + 1):  # Gaussian binomial coefficient
        up, down = n1 + i, i
        for k in range(len(ways) - 1, up - 1, -1):
            ways[k] -= ways[k - up]
        for k in range(down, len(ways)):
            ways[k] += ways[k - down]
    tail = ways[: int(min(u, n1 * n2 - u)) + 1].sum() / ways.sum()
    return float(min(1.0, 2 * tail))


@analysis("mann_whitney")
def mann_whitney(df: DataFrame, column1: str, column2: str) -> dict:
    """Two-sided rank sum test of two columns over the rows complete in both."""
    rows = _complete(df, [column1, column2])
    # each column's values are counted apart; what is ranked are the counts
    side = lambda c, one: rows.groupBy(_x(c).alias("v")).agg(F.count("*").alias("n"), F.lit(one).alias("one"))
    both = side(column1, 1).unionByName(side(column2, 0))
    table = ranks.counted_ranks(both.groupBy("v").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("one")).alias("n1")))
    t = F.col("n").cast("double")
    r = _row(table, n1=F.sum("n1"), n=F.sum("n"), r1=F.sum(F.col("n1") * F.col("rank")), ties=F.sum(t * t * t - t))
    _need((r["n1"] or 0) >= 1, "complete rows are needed")
    n1, n2 = r["n1"], r["n"] - r["n1"]
    u1 = r["r1"] - n1 * (n1 + 1) / 2
    n = n1 + n2
    if not r["ties"] and min(n1, n2) <= 8:
        p = _exact_ranksum(u1, n1, n2)
    else:
        s = math.sqrt(n1 * n2 / 12 * (n + 1 - r["ties"] / (n * (n - 1))))
        z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / s if s else math.nan
        p = min(1.0, 2 * D.normal_sf(z)) if s else 1.0
    m1, m2 = _quantiles(rows, _x(column1), 0.5)[0], _quantiles(rows, _x(column2), 0.5)[0]
    return {"u_statistic": u1, "p_value": p, "median1": m1, "median2": m2, "n1": n1, "n2": n2}


@analysis("wilcoxon_signed_rank")
def wilcoxon(df: DataFrame, before: str, after: str) -> dict:
    """Two-sided signed rank test; zero differences are left out."""
    rows = _complete(df, [before, after])
    d = rows.select((_x(before) - _x(after)).alias("d")).filter("d <> 0")
    table = ranks.value_ranks(d.select(F.abs("d").alias("v"), (F.col("d") > 0).cast("long").alias("up")), {"up": F.sum("up")})
    t = F.col("n").cast("double")
    r = _row(table, n=F.sum("n"), plus=F.sum(F.col("up") * F.col("rank")), ties=F.sum(t * t * t - t))
    n = r["n"] or 0
    _need(n >= 1, "differences other than zero are needed")
    w = min(r["plus"], n * (n + 1) / 2 - r["plus"])
    if n <= 50 and not r["ties"]:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        p = float(min(1.0, 2 * ways[: int(w) + 1].sum() / ways.sum()))
    else:
        s = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - r["ties"] / 48)
        p = 2 * D.normal_sf(abs(w - n * (n + 1) / 4) / s)
    m1, m2 = _quantiles(rows, _x(before), 0.5)[0], _quantiles(rows, _x(after), 0.5)[0]
    return {"w_statistic": w, "p_value": p, "median_before": m1, "median_after": m2, "n": n}


@analysis("kruskal_wallis")
def kruskal_wallis(df: DataFrame, value: str, group: str) -> dict:
    """H with the correction for ties."""
    rows = _complete(df, [value, group]).select(_x(value).alias("v"), compat.col(group).alias("g"))
    table = ranks.value_ranks(rows.select("v"))
    cells = rows.groupBy("v", "g").agg(F.count(F.lit(1)).alias("c")).join(table.select("v", "rank"), "v")
    groups = cells.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    t = F.col("n").cast("double")
    ties = _row(table, x=F.sum(t * t * t - t))["x"] or 0
    r = _row(groups, k=F.count(F.lit(1)), n=F.sum("n"), s=F.sum(F.col("r") * F.col("r") / F.col("n")))
    _need(r["k"] >= 2, "two groups are needed")
    n = r["n"]
    h = (12 / (n * (n + 1)) * r["s"] - 3 * (n + 1)) / (1 - ties / (n**3 - n)) if ties < n**3 - n else math.nan
    return {"h_statistic": h, "p_value": D.chi2_sf(h, r["k"] - 1), "df": r["k"] - 1, "n_groups": r["k"], "n": n}


# ---------------------------------------------------------------- normality


#: Coefficients of the approximation to the weights' ends and of the p-value; fixed values.
_W1 = (-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0)
_W2 = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)


def _poly(c, x: float) -> float:
    return reduce(lambda s, a: s * x + a, c, 0.0)


def _shapiro(ends: dict, n: int, ss: float, mm: float, mx: float) -> tuple[float, float]:
    """W and p from the outermost values, and the sums of m * m and m * v over the rows' normal scores m."""
    if n == 3:
        w = 0.5 * (ends[2] - ends[0]) ** 2 / ss
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(min(1, w))) - math.asin(math.sqrt(0.75))))
    q = lambda i: D.normal_quantile((i - 0.375) / (n + 0.25))
    u, top, second = 1 / math.sqrt(n), q(n), q(n - 1)
    a_n, a_m = _poly(_W1, u) + top / math.sqrt(mm), 0.0
    two = n > 5  # two weights at each end are approximated, else one
    if two:
        a_m = _poly(_W2, u) + second / math.sqrt(mm)
    phi = (mm - 2 * top**2 - 2 * second**2 * two) / (1 - 2 * a_n**2 - 2 * a_m**2)
    wide, inner = ends[n - 1] - ends[0], ends[n - 2] - ends[1]
    b = (mx - top * wide - second * inner * two) / math.sqrt(phi) + a_n * wide + a_m * inner
    w = min(1.0, b * b / ss)
    y, ln = math.log(max(1e-300, 1 - w)), math.log(n)
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu, sd = _poly((-0.0006714, 0.025054, -0.39978, 0.544), n), math.exp(_poly((-0.0020322, 0.062767, -0.77857, 1.3822), n))
    else:
        mu, sd = _poly((0.0038915, -0.083751, -0.31082, -1.5861), ln), math.exp(_poly((0.0030302, -0.082676, -0.4803), ln))
    return w, D.normal_sf((y - mu) / sd)


@analysis("normality_test")
def normality_test(df: DataFrame, column: str) -> dict:
    """Shapiro-Wilk, Anderson-Darling and Kolmogorov-Smirnov against the fitted normal distribution.

    All three are sums or maxima over rows that know their place in the order;
    each batch of rows adds its part.
    """
    rows = df.select(_x(column).alias("v")).filter("v is not null")
    v = F.col("v")
    r = _row(rows, n=F.count(v), mean=F.avg(v), std=F.stddev_samp(v), skewness=F.skewness(v), kurtosis=F.kurtosis(v))
    n, mean, std = r["n"], r["mean"], r["std"]
    _need(n >= 3 and (std or 0) > 0, "three values that differ are needed")
    share_package(df.sparkSession)

    def parts(batches):
        for pdf in batches:
            i, x = pdf["i"].to_numpy(), pdf["v"].to_numpy()
            z = (x - mean) / std
            below, above = D.normal_sf_array(-z), D.normal_sf_array(z)
            m = D.normal_quantile_array((i + 0.625) / (n + 0.25))
            logs = (2 * i + 1) * np.log(np.maximum(below, 1e-300)) + (2 * (n - i) - 1) * np.log(np.maximum(above, 1e-300))
            gap = np.maximum((i + 1) / n - below, below - i / n)
            yield pd.DataFrame({"mm": [(m * m).sum()], "mx": [(m * x).sum()], "a": [logs.sum()], "d": [gap.max(initial=0.0)]})

    indexed = ordered.with_index(rows, [v.asc()], "i")
    got = _row(indexed.mapInPandas(parts, "mm double, mx double, a double, d double"), mm=F.sum("mm"), mx=F.sum("mx"), a=F.sum("a"), d=F.max("d"))
    ends = {e.i: e.v for e in indexed.filter((F.col("i") < 2) | (F.col("i") >= n - 2)).collect()}
    w, p = _shapiro(ends, n, std**2 * (n - 1), got["mm"], got["mx"])
    return {
        "shapiro_statistic": w, "shapiro_p_value": p, "anderson_statistic": -n - got["a"] / n,
        "ks_statistic": got["d"], "ks_p_value": D.kolmogorov_sf(got["d"], n), "skewness": r["skewness"], "kurtosis": r["kurtosis"], "n": n,
    }


# ---------------------------------------------------------------- regression


def _gram(rows: DataFrame, xs: list[Column], weight: Column, target: Column) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy from one aggregate."""
    k = len(xs)
    cells = {f"{i}_{j}": F.sum(weight * xs[i] * xs[j]) for i in range(k) for j in range(i, k)} | {f"y{i}": F.sum(weight * xs[i] * target) for i in range(k)}
    r = _row(rows, **cells)
    g = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return g, np.array([r[f"y{i}"] for i in range(k)], float)


def _uncentred(beta: np.ndarray, cov: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance for the predictors before their means were taken off."""
    t = np.eye(len(beta))
    t[0, 1:] = -shift
    return t @ beta, t @ cov @ t.T


@analysis("regression_ols", "linear-regression", "simple-linear-regression", "regression")
def regression_ols(df: DataFrame, y: str, x) -> dict:
    """Least squares with a constant, from centred cross products: two passes."""
    names = compat.names(x)
    rows, k = _complete(df, [y, *names]), len(names)
    m = _row(rows, n=F.count(F.lit(1)), y=F.avg(_x(y)), **{f"m{i}": F.avg(_x(c)) for i, c in enumerate(names)})
    n = m["n"]
    _need(n >= k + 2, "too few complete rows")
    shift = np.array([m[f"m{i}"] for i in range(k)])
    xs = [F.lit(1.0), *[_x(c) - F.lit(float(s)) for c, s in zip(names, shift)]]
    target = _x(y) - F.lit(float(m["y"]))
    g, v = _gram(rows, xs, F.lit(1.0), target)
    beta = np.linalg.solve(g, v)
    fit = reduce(operator.add, [F.lit(float(b)) * c for b, c in zip(beta, xs)])
    s = _row(rows, sse=F.sum((target - fit) * (target - fit)), sst=F.sum(target * target))
    dof = n - k - 1
    sigma2 = s["sse"] / dof
    beta[0] += m["y"]
    beta, cov = _uncentred(beta, sigma2 * np.linalg.inv(g), shift)
    se = np.sqrt(np.diag(cov))
    r2 = 1 - s["sse"] / s["sst"] if s["sst"] else math.nan
    f = (r2 / k) / ((1 - r2) / dof) if r2 < 1 else math.inf
    keys = ["const", *names]
    t = beta / np.where(se > 0, se, np.nan)
    by = lambda a: dict(zip(keys, map(float, a)))
    return {
        "n": n, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / dof, "f_statistic": f, "f_p_value": D.f_sf(f, k, dof),
        "residual_std_error": math.sqrt(sigma2), "coefficients": by(beta), "std_errors": by(se), "t_values": by(t),
        "p_values": by([D.t_two_sided(v, dof) for v in t]),
    }


@analysis("logistic_regression", "logistic-regression")
def logistic_regression(df: DataFrame, y: str, x, rounds: int = 50) -> dict:
    """Maximum likelihood by Newton's method: one aggregate a round over the complete rows."""
    names = compat.names(x)
    rows, k = _complete(df, [y, *names]), len(names)
    m = _row(rows, n=F.count(F.lit(1)), ones=F.sum(_x(y)), lo=F.min(_x(y)), hi=F.max(_x(y)), **{f"m{i}": F.avg(_x(c)) for i, c in enumerate(names)}, **{f"s{i}": F.stddev_pop(_x(c)) for i, c in enumerate(names)})
    n = m["n"]
    _need(n >= k + 10, "too few complete rows")
    _need(m["lo"] == 0 and m["hi"] == 1, "the outcome must be 0 or 1, and both must occur")
    shift, scale = np.array([m[f"m{i}"] for i in range(k)]), np.array([m[f"s{i}"] or 1.0 for i in range(k)])
    xs = [F.lit(1.0), *[(_x(c) - F.lit(float(a))) / F.lit(float(b)) for c, a, b in zip(names, shift, scale)]]
    target, share = _x(y), m["ones"] / n
    beta = np.zeros(k + 1)
    beta[0] = math.log(share / (1 - share))
    for _ in range(rounds):
        eta = reduce(operator.add, [F.lit(float(b)) * c for b, c in zip(beta, xs)])
        p = 1 / (1 + F.exp(-eta))
        g, _ = _gram(rows, xs, p * (1 - p), F.lit(0.0))
        score = _row(rows, **{f"g{i}": F.sum((target - p) * c) for i, c in enumerate(xs)})
        step = np.linalg.solve(g, np.array([score[f"g{i}"] for i in range(k + 1)]))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    eta = reduce(operator.add, [F.lit(float(b)) * c for b, c in zip(beta, xs)])
    # log(1 + e^eta) without overflow
    llf = _row(rows, l=F.sum(target * eta - (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))))))["l"]
    null = n * (share * math.log(share) + (1 - share) * math.log(1 - share))
    unscale = np.diag([1.0, *(1 / scale)])
    beta, cov = _uncentred(unscale @ beta, unscale @ np.linalg.inv(g) @ unscale, shift)
    se = np.sqrt(np.diag(cov))
    z = beta / se
    by = lambda a: dict(zip(["const", *names], map(float, a)))
    return {
        "n": n, "pseudo_r_squared": 1 - llf / null, "log_likelihood": llf, "aic": 2 * (k + 1) - 2 * llf,
        "bic": (k + 1) * math.log(n) - 2 * llf, "coefficients": by(beta), "std_errors": by(se), "z_values": by(z),
        "p_values": by([2 * D.normal_sf(abs(v)) for v in z]), "odds_ratios": by(np.exp(np.clip(beta, -700, 700))),
    }


# ---------------------------------------------------------------- series and outliers


def _indexed(df: DataFrame, order_by) -> DataFrame:
    """Rows with ``i`` from 0: by the order column, else in scan order."""
    from ..operators.rows import add_index_column

    return add_index_column(df, name="i", start=0, order_by=order_by)


@analysis("moving_average", "moving-averages")
def moving_average(df: DataFrame, column: str, window: int = 7, order_by=None) -> DataFrame:
    """(i, value, moving_average); null until the window is full."""
    rows = _indexed(df.filter(compat.col(column).isNotNull()), order_by).select("i", _x(column).alias("value"))
    n = int(window)
    mean = lambda w: F.when(F.col("i") >= n - 1, F.avg("value").over(w.rowsBetween(-(n - 1), 0)))
    return ordered.trailing(rows, [F.col("i").asc()], n - 1, 0, mean, "moving_average")


@analysis("trend_analysis")
def trend_analysis(df: DataFrame, column: str, time_col=None) -> dict:
    """A line through the values against their number in order of time."""
    rows = _indexed(df.filter(compat.col(column).isNotNull()), time_col)
    x, y = F.col("i").cast("double"), _x(column)
    r = _row(rows, n=F.count(y), slope=F.regr_slope(y, x), intercept=F.regr_intercept(y, x), r=F.corr(x, y))
    _need(r["n"] >= 3, "three values are needed")
    return {"n": r["n"], "slope": r["slope"], "intercept": r["intercept"], "r_squared": r["r"] ** 2, "p_value": _r_p(r["r"], r["n"])}


def trend_line(df: DataFrame, column: str, time_col=None) -> DataFrame:
    """(i, value, trend, detrended) of every row."""
    t = trend_analysis(df, column, time_col)
    rows = _indexed(df.filter(compat.col(column).isNotNull()), time_col).select("i", _x(column).alias("value"))
    line = F.lit(t["slope"]) * F.col("i") + F.lit(t["intercept"])
    return rows.withColumn("trend", line).withColumn("detrended", F.col("value") - line)


@analysis("outlier_detection", "outliers")
def outlier_detection(df: DataFrame, column: str, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """The rows beyond the threshold, with their score."""
    x = _x(column)
    if method == "zscore":
        r = _row(df, m=F.avg(x), s=F.stddev_pop(x))
        score = (x - F.lit(r["m"])) / F.nullif(F.lit(r["s"]), F.lit(0.0))
        out = F.abs(score) > threshold
    elif method == "iqr":
        q1, q3 = _quantiles(df, x, 0.25, 0.75)
        lo, hi = F.lit(q1) - threshold * (F.lit(q3) - F.lit(q1)), F.lit(q3) + threshold * (F.lit(q3) - F.lit(q1))
        score, out = F.greatest(lo - x, x - hi), (x < lo) | (x > hi)
    elif method == "modified_z":
        median = _quantiles(df, x, 0.5)[0]
        mad = _quantiles(df, F.abs(x - F.lit(median)), 0.5)[0]
        score = 0.6745 * (x - F.lit(median)) / F.nullif(F.lit(mad), F.lit(0.0))
        out = F.abs(score) > threshold
    else:
        raise ValueError(f"unknown method: {method}")
    return df.withColumn("outlier_score", score).filter(out)


# ---------------------------------------------------------------- dispatch

#: Results that are kept, the least recently used going first.
MOST_RESULTS = 256
_cache: OrderedDict[str, dict] = OrderedDict()


def result(df: DataFrame, name: str, params: dict | None = None, fingerprint: str | None = None):
    """The analysis' own result; dictionaries are kept by dataset fingerprint and parameters."""
    if name not in ANALYSES:
        raise ValueError(f"unknown analysis: {name}")
    key = json.dumps([fingerprint, name, params], sort_keys=True, default=str)
    if fingerprint and key in _cache:
        _cache.move_to_end(key)
        return _cache[key]
    found = ANALYSES[name](df, **(params or {}))
    if fingerprint and isinstance(found, dict):
        _cache[key] = found
        while len(_cache) > MOST_RESULTS:
            _cache.popitem(last=False)
    return found


def _flat(value: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in value.items():
        if isinstance(v, dict):
            out |= _flat(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = v
    return out


def analyse(df: DataFrame, name: str, params: dict | None = None, fingerprint: str | None = None) -> DataFrame:
    """The result as a DataFrame: its rows, or one row (measure, value, label) for each number."""
    found = result(df, name, params, fingerprint)
    if isinstance(found, DataFrame):
        return found
    flat = _flat(found)
    rows = [(k, float(v) if isinstance(v, (int, float)) else None, v if isinstance(v, str) else None) for k, v in flat.items() if not isinstance(v, DataFrame)]
    out = df.sparkSession.createDataFrame(rows, "measure string, value double, label string")
    for k, v in flat.items():
        if isinstance(v, DataFrame):  # a row for each group: its name and numbers
            name, *numbers = v.columns
            cells = F.array(*[F.struct(F.concat_ws(".", F.lit(k), F.col(name).cast("string"), F.lit(c)).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers])
            out = out.union(v.select(F.explode(cells).alias("c")).select("c.measure", "c.value", F.lit(None).cast("string")))
    return out
