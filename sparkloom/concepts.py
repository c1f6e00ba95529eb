"""A registry of statistical concepts and what computes them here.

A concept with a function takes a DataFrame (or numbers) and parameters; others
name the step, analysis or Spark class to use, or why there is none; those of
the last two kinds are in :func:`left_to_others`.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import compat
from .models import clusters, features, glm, likelihood, linear, quantile, selection, trees
from .models.passes import added, complete, uniform
from .operators import ordered
from .session import share_package
from .stats import analyses as A
from .stats import distributions as D


@dataclass(frozen=True)
class Concept:
    slug: str
    topic: str
    run: Callable | None
    use: str = ""


CONCEPTS: dict[str, Concept] = {}


def concept(topic: str, *slugs: str):
    def add(fn):
        for s in slugs:
            CONCEPTS[s] = Concept(s, topic, fn)
        return fn

    return add


def _points_to(topic: str, use: str, *slugs: str, run: Callable | None = None) -> None:
    for s in slugs:
        CONCEPTS[s] = Concept(s, topic, run, use)


def search(text: str) -> list[Concept]:
    """Concepts whose slug, topic or use holds the text."""
    low = text.lower()
    return [c for c in CONCEPTS.values() if low in f"{c.slug} {c.topic} {c.use}".lower()]


def left_to_others() -> list[str]:
    """Concepts that nothing here computes: the name of a Spark class, or of nothing."""
    return sorted(c.slug for c in CONCEPTS.values() if c.run is None and ("pyspark" in c.use or "no Spark plan" in c.use or "fits on" in c.use))


def _x(c: str):
    return compat.col(c).cast("double")


_row = A._row

# ---------------------------------------------------------------- what steps and analyses cover

for _topic, _slugs in {
    "descriptive": "mean standard-deviation",
    "hypothesis": "one-sample-t-test two-sample-t-test paired-t-test anova-one-way chi-square-test",
    "correlation": "pearson-correlation spearman-correlation",
    "advanced": "logistic-regression",
    "regression": "simple-linear-regression",
    "time series": "moving-averages",
}.items():
    for _s in _slugs.split():
        _points_to(_topic, f"stats.ANALYSES[{_s!r}]", _s, run=A.ANALYSES[_s])
_points_to("descriptive", "detailed_descriptives", "median", "kurtosis", "skewness", "interquartile-range", run=A.detailed_descriptives)
_points_to("descriptive", "outlier_detection", "outliers", run=A.outlier_detection)
_points_to("descriptive", "the steps percentile, quartiles and mode, z_score and variance", "percentiles", "quantiles", "mode", "z-score", "variance")
_points_to("correlation", "the step covariance", "covariance")
_points_to("correlation", "correlation with method kendall", "kendall-tau", run=lambda df, x, y: A.correlation(df, x, y, "kendall"))
_points_to("advanced", "mann_whitney and kruskal_wallis", "nonparametric-tests", run=A.kruskal_wallis)
_points_to("advanced", "odds_ratios of logistic_regression", "odds-ratios", run=A.logistic_regression)
_points_to("regression", "regression_ols", "multiple-linear-regression", "coefficient-interpretation", "hypothesis-tests-for-betas", "r-squared", run=A.regression_ols)
_points_to("eda", "plans.profile", "exploratory-data-analysis")
_points_to("advanced", "models.glm", "generalized-linear-models", run=glm.generalized_linear_model)
_points_to("advanced", "models.clusters", "k-means-clustering", run=clusters.k_means)
_points_to("advanced", "models.clusters", "principal-component-analysis", run=clusters.principal_components)
_points_to("advanced", "models.clusters", "silhouette-score", run=clusters.silhouette)
_points_to("predictive", "models.linear", "cross-validation", "hyperparameter-tuning", run=linear.cross_validate)
_points_to("predictive", "models.trees", "decision-trees", run=trees.decision_tree)
_points_to("predictive", "models.trees", "random-forest", run=trees.random_forest)
_points_to("predictive", "models.trees", "gradient-boosting", "xgboost", run=trees.gradient_boosting)
_points_to("predictive", "models.selection", "feature-selection", run=selection.feature_scores)
_points_to("predictive", "models.features", "feature-engineering", run=features.engineered)
_points_to("predictive", "models.linear", "learning-curves", run=linear.learning_curve)
_points_to("regression", "models.linear", "elastic-net", run=linear.elastic_net)
_points_to("regression", "models.linear", "regularization-lasso", run=linear.lasso)
_points_to("regression", "models.linear", "regularization-ridge", run=linear.ridge)
_points_to("advanced", "models.quantile", "quantile-regression", run=quantile.quantile_regression)
_points_to("advanced", "models.likelihood", "maximum-likelihood-estimation", run=likelihood.fit)
_points_to("time series", "no Spark plan; takes a library of its own", "arima", "sarima", "prophet")

# ---------------------------------------------------------------- descriptions


@concept("descriptive", "coefficient-of-variation")
def coefficient_of_variation(df: DataFrame, column: str) -> float | None:
    r = _row(df, m=F.avg(_x(column)), s=F.stddev_samp(_x(column)))
    return r["s"] / r["m"] if r["m"] and r["s"] is not None else None


@concept("descriptive", "mad")
def median_absolute_deviation(df: DataFrame, column: str) -> float | None:
    median = A._quantiles(df, _x(column), 0.5)[0]
    return A._quantiles(df, F.abs(_x(column) - F.lit(median)), 0.5)[0]


@concept("descriptive", "range")
def value_range(df: DataFrame, column: str) -> float | None:
    return _row(df, r=F.max(_x(column)) - F.min(_x(column)))["r"]


# ---------------------------------------------------------------- correlation


def _correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    m = A.correlation_matrix(df, columns)["matrix"]
    return np.array([[m[a][b] for b in columns] for a in columns], float)


@concept("correlation", "multicollinearity")
def variance_inflation(df: DataFrame, columns: list[str]) -> dict:
    """Diagonal of the inverse correlation matrix."""
    return dict(zip(columns, np.diag(np.linalg.inv(_correlations(df, columns))).tolist()))


@concept("correlation", "partial-correlation")
def partial_correlation(df: DataFrame, x: str, y: str, given: list[str]) -> float:
    p = np.linalg.inv(_correlations(df, [x, y, *given]))
    return float(-p[0, 1] / math.sqrt(p[0, 0] * p[1, 1]))


# ---------------------------------------------------------------- resampling and estimation


#: Rows whose draws a task holds at a time.
_DRAWN_ROWS = 2048


@concept("advanced", "bootstrapping")
def bootstrap_mean(df: DataFrame, column: str, replicates: int = 200, seed: int = 0, level: float = 0.95) -> dict:
    """Percentile interval of the mean: each row weighs a Poisson number in each replicate.

    No row is copied: a task draws its rows' weights in blocks and keeps two sums
    for each replicate.  Draws go by a row's place in the scan.
    """
    own = complete(df, [column]).select(F.monotonically_increasing_id().alias("id"), _x(column).alias("v"))
    limits = np.cumsum([math.exp(-1 - math.lgamma(k + 1)) for k in range(20)])

    def sums(z: np.ndarray) -> np.ndarray:
        out = np.zeros((replicates, 2))
        for i in range(0, len(z), _DRAWN_ROWS):
            part = z[i : i + _DRAWN_ROWS]
            w = np.searchsorted(limits, uniform(part[:, 0], replicates, seed)).astype(float)
            out += np.column_stack([w.sum(0), part[:, 1] @ w])
        return out

    got = added(own, sums, (replicates, 2))
    means = got[got[:, 0] > 0, 1] / got[got[:, 0] > 0, 0]
    if not len(means):
        return {"low": None, "high": None, "std_error": None}
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return {"low": float(low), "high": float(high), "std_error": float(means.std(ddof=1))}


@concept("advanced", "permutation-tests")
def permutation_test(df: DataFrame, value: str, group: str, replicates: int = 500, seed: int = 0) -> dict:
    """Difference of two groups' means against random labels of the same share, all replicates in one pass without copies of rows."""
    own = df.select(F.monotonically_increasing_id().alias("id"), _x(value).alias("v"), compat.col(group).cast("boolean").cast("double").alias("g")).dropna()
    real = _row(own, n=F.count(F.lit(1)), n1=F.sum("g"), s=F.sum("v"), s1=F.sum(F.col("g") * F.col("v")))
    n, n1 = real["n"], real["n1"] or 0
    if not 0 < n1 < n:
        raise ValueError("both groups must occur")
    difference = real["s1"] / n1 - (real["s"] - real["s1"]) / (n - n1)

    def sums(z: np.ndarray) -> np.ndarray:
        out = np.zeros((replicates, 2))
        for i in range(0, len(z), _DRAWN_ROWS):
            part = z[i : i + _DRAWN_ROWS]
            w = (uniform(part[:, 0], replicates, seed) < n1 / n).astype(float)
            out += np.column_stack([w.sum(0), part[:, 1] @ w])
        return out

    got = added(own, sums, (replicates, 2))
    k, s1 = got[:, 0], got[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        drawn = s1 / k - (real["s"] - s1) / (n - k)
    return {"difference": difference, "p_value": (int((np.abs(drawn) >= abs(difference)).sum()) + 1) / (replicates + 1)}


@concept("estimation", "ci-mean", "confidence-intervals")
def ci_mean(df: DataFrame, column: str, level: float = 0.95) -> dict:
    r = _row(df, n=F.count(_x(column)), m=F.avg(_x(column)), s=F.stddev_samp(_x(column)))
    half = D.t_quantile(1 - level, r["n"] - 1) * r["s"] / math.sqrt(r["n"])
    return {"mean": r["m"], "low": r["m"] - half, "high": r["m"] + half}


@concept("estimation", "ci-proportion")
def ci_proportion(df: DataFrame, column: str, level: float = 0.95) -> dict:
    """Wilson's interval of the share of true values."""
    flag = compat.col(column).cast("boolean").cast("int")
    r = _row(df, n=F.count(flag), k=F.sum(flag))
    n, p, z = r["n"], r["k"] / r["n"], D.normal_quantile(0.5 + level / 2)
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return {"proportion": p, "low": mid - half, "high": mid + half}


@concept("estimation", "sample-size")
def sample_size(margin: float, std: float, level: float = 0.95) -> int:
    return math.ceil((D.normal_quantile(0.5 + level / 2) * std / margin) ** 2)


@concept("estimation", "sampling-methods")
def stratified_sample(df: DataFrame, column: str, fractions: dict, seed: int = 0) -> DataFrame:
    return df.sampleBy(column, fractions, seed)


# ---------------------------------------------------------------- tests


@concept("hypothesis", "bonferroni")
def bonferroni(df: DataFrame, p: str, name: str = "p_adjusted") -> DataFrame:
    n = df.agg(F.count(compat.col(p)).alias("__m"))
    return df.crossJoin(F.broadcast(n)).withColumn(name, F.least(F.lit(1.0), _x(p) * F.col("__m"))).drop("__m")


@concept("hypothesis", "fdr")
def benjamini_hochberg(df: DataFrame, p: str, name: str = "p_adjusted") -> DataFrame:
    """p times m over its rank, and no more than that of any larger p."""
    m = df.agg(F.count(compat.col(p)).alias("__m"))
    ranked = ordered.ranked(df.filter(compat.col(p).isNotNull()), [compat.col(p).asc()], [p], "__r", "row_number")
    raw = ranked.crossJoin(F.broadcast(m)).withColumn("__q", _x(p) * F.col("__m") / F.col("__r"))
    best = ordered.running(raw, [F.col("__r").desc()], {"m": (F.min, F.col("__q"), F.least)}, lambda v: F.least(F.lit(1.0), v["m"]), name)
    return best.drop("__r", "__m", "__q")


@concept("hypothesis", "effect-size")
def cohens_d(df: DataFrame, column1: str, column2: str) -> float:
    a, b = _x(column1), _x(column2)
    r = _row(df, m1=F.avg(a), m2=F.avg(b), v1=F.var_samp(a), v2=F.var_samp(b), n1=F.count(a), n2=F.count(b))
    pooled = ((r["n1"] - 1) * r["v1"] + (r["n2"] - 1) * r["v2"]) / (r["n1"] + r["n2"] - 2)
    return (r["m1"] - r["m2"]) / math.sqrt(pooled)


@concept("hypothesis", "fishers-exact-test")
def fishers_exact(df: DataFrame, column1: str, column2: str) -> dict:
    """Two-sided, from the four counts of two boolean columns."""
    a, b = compat.col(column1).cast("boolean"), compat.col(column2).cast("boolean")
    r = _row(df, a=F.sum((a & b).cast("int")), b=F.sum((a & ~b).cast("int")), c=F.sum((~a & b).cast("int")), d=F.sum((~a & ~b).cast("int")))
    n11, n12, n21, n22 = (int(r[k] or 0) for k in "abcd")
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    rows, cols, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    log = lambda k: choose(rows, k) + choose(n - rows, cols - k) - choose(n, cols)
    real = log(n11)
    p = sum(math.exp(log(k)) for k in range(max(0, rows + cols - n), min(rows, cols) + 1) if log(k) <= real + 1e-7)
    return {"odds_ratio": n11 * n22 / (n12 * n21) if n12 * n21 else math.inf, "p_value": min(1.0, p)}


@concept("hypothesis", "p-value")
def p_value(statistic: float, distribution: str = "normal", *dof: float) -> float:
    tails = {"normal": lambda z: 2 * D.normal_sf(abs(z)), "t": D.t_two_sided, "chi2": D.chi2_sf, "f": D.f_sf}
    return tails[distribution](statistic, *dof)


@concept("hypothesis", "post-hoc-tests")
def post_hoc(df: DataFrame, value: str, group: str, groups: list | None = None, pairs: list[tuple] | None = None) -> DataFrame:
    """(a, b, t_statistic, p_value): Welch tests of all pairs of groups, of the pairs of some, or of given pairs.

    Bonferroni's correction is for the number of pairs really tested; groups of
    fewer than two values can't be.
    """
    g = df.filter(compat.col(group).isNotNull()).groupBy(compat.col(group).alias("g")).agg(F.count(_x(value)).alias("n"), F.avg(_x(value)).alias("m"), F.var_samp(_x(value)).alias("v")).filter("n > 1")
    if groups is not None:
        g = g.filter(F.col("g").isin(list(groups)))
    side = lambda s: g.select(*[F.col(c).alias(f"{c}{s}") for c in g.columns])
    if pairs is not None:
        kind = g.schema["g"].dataType.simpleString()
        both = df.sparkSession.createDataFrame(list(pairs), f"ga {kind}, gb {kind}").distinct().join(side("a"), "ga").join(side("b"), "gb")
    else:
        both = side("a").join(side("b"), F.col("ga") < F.col("gb"))
    m = both.count()
    e1, e2 = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    tests = both.select(
        F.col("ga").alias("a"), F.col("gb").alias("b"),
        F.when(e1 + e2 > 0, (F.col("ma") - F.col("mb")) / F.sqrt(e1 + e2)).otherwise(F.lit(math.nan)).alias("t_statistic"),
        F.when(e1 + e2 > 0, (e1 + e2) ** 2 / (e1**2 / (F.col("na") - 1) + e2**2 / (F.col("nb") - 1))).otherwise(F.lit(math.nan)).alias("dof"),
    )
    share_package(df.sparkSession)

    @F.pandas_udf("double")
    def tail(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([math.nan if math.isnan(a) else min(1.0, m * D.t_two_sided(a, b)) for a, b in zip(t, dof)], dtype=float)

    return tests.select("a", "b", "t_statistic", tail("t_statistic", "dof").alias("p_value"))


def p_values(df: DataFrame, statistic: str, distribution: str = "normal", dof=(), name: str = "p_value") -> DataFrame:
    """:func:`p_value` of each row's statistic; ``dof`` are columns, or numbers, with the degrees of freedom."""
    share_package(df.sparkSession)
    own = [compat.col(d) if isinstance(d, str) else F.lit(float(d)) for d in ([dof] if isinstance(dof, (str, int, float)) else dof)]

    @F.pandas_udf("double")
    def tail(*columns: pd.Series) -> pd.Series:
        rows = zip(*(c.astype(float) for c in columns))
        return pd.Series([math.nan if any(math.isnan(v) for v in r) else p_value(r[0], distribution, *r[1:]) for r in rows], dtype=float)

    got = tail(_x(statistic), *[d.cast("double") for d in own])
    return df.withColumn(name, F.when(F.isnan(got), None).otherwise(got))


def sample_sizes(df: DataFrame, std: str, margin: float, level: float = 0.95, name: str = "sample_size") -> DataFrame:
    """:func:`sample_size` for each row's standard deviation."""
    return df.withColumn(name, F.ceil(F.pow(F.lit(D.normal_quantile(0.5 + level / 2)) * _x(std) / F.lit(float(margin)), F.lit(2.0))))


def powers(df: DataFrame, effect: str, n: str, alpha: float = 0.05, name: str = "power") -> DataFrame:
    """:func:`power` for each row's effect and number of rows."""
    share_package(df.sparkSession)

    @F.pandas_udf("double")
    def of(e: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([math.nan if math.isnan(a) or math.isnan(b) else power(a, b, alpha) for a, b in zip(e.astype(float), k.astype(float))], dtype=float)

    got = of(_x(effect), _x(n))
    return df.withColumn(name, F.when(F.isnan(got), None).otherwise(got))


def significant(df: DataFrame, p: str, confidence: float = 0.95, name: str = "significant") -> DataFrame:
    """Whether each row's p is within the significance level."""
    return df.withColumn(name, _x(p) <= F.lit(significance_level(confidence)))


def tukey(df: DataFrame, value: str, group: str) -> DataFrame:
    """(a, b, difference, q_statistic, p_value): all pairs of groups by the studentized range of the pooled deviation.

    Groups of different sizes have the harmonic mean of their sizes.  Groups
    without values have no pairs; one value is enough if other groups have more.
    """
    g = df.filter(compat.col(group).isNotNull()).groupBy(compat.col(group).alias("g")).agg(F.count(_x(value)).alias("n"), F.avg(_x(value)).alias("m"), F.coalesce(F.var_samp(_x(value)), F.lit(0.0)).alias("v")).filter("n > 0")
    r = _row(g, k=F.count(F.lit(1)), n=F.sum("n"), s=F.sum((F.col("n") - 1) * F.col("v")))
    if r["k"] < 2 or r["n"] <= r["k"]:
        raise ValueError("two groups are needed, and more rows than groups")
    dof, count, mse = r["n"] - r["k"], r["k"], r["s"] / (r["n"] - r["k"])
    side = lambda s: g.select(*[F.col(c).alias(f"{c}{s}") for c in "gnm"])
    both = side("a").join(side("b"), F.col("ga") < F.col("gb"))
    width = F.sqrt(F.lit(mse) / 2 * (1 / F.col("na") + 1 / F.col("nb")))
    share_package(df.sparkSession)

    @F.pandas_udf("double")
    def tail(q: pd.Series) -> pd.Series:
        return pd.Series([D.studentized_range_sf(v, count, dof) for v in q], dtype=float)

    difference = F.col("ma") - F.col("mb")
    tests = both.select(F.col("ga").alias("a"), F.col("gb").alias("b"), difference.alias("difference"), F.when(width > 0, F.abs(difference) / width).alias("q_statistic"))
    return tests.withColumn("p_value", F.when(F.col("q_statistic").isNotNull(), tail(F.coalesce("q_statistic", F.lit(0.0)))))


@concept("hypothesis", "power")
def power(effect: float, n: int, alpha: float = 0.05) -> float:
    """Of a two-sided z test of one mean, the effect being in standard deviations."""
    z, shift = D.normal_quantile(1 - alpha / 2), effect * math.sqrt(n)
    return D.normal_sf(z - shift) + D.normal_cdf(-z - shift)


@concept("hypothesis", "significance-level")
def significance_level(confidence: float = 0.95) -> float:
    return 1 - confidence


@concept("hypothesis", "z-test")
def z_test(df: DataFrame, column: str, mean: float = 0.0, std: float | None = None) -> dict:
    r = _row(df, n=F.count(_x(column)), m=F.avg(_x(column)), s=F.stddev_samp(_x(column)))
    z = (r["m"] - mean) / ((std or r["s"]) / math.sqrt(r["n"]))
    return {"z_statistic": z, "p_value": 2 * D.normal_sf(abs(z)), "n": r["n"]}


# ---------------------------------------------------------------- predictions


def _cells(df: DataFrame, label: str, prediction: str) -> dict:
    y, p = compat.col(label).cast("int") == 1, compat.col(prediction).cast("int") == 1
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return _row(df, tp=n(y & p), fp=n(~y & p), fn=n(y & ~p), tn=n(~y & ~p))


def _share(a: float, b: float) -> float:
    return a / b if b else math.nan


@concept("predictive", "accuracy")
def accuracy(df: DataFrame, label: str, prediction: str) -> float:
    return _row(df, a=F.avg((compat.col(label) == compat.col(prediction)).cast("double")))["a"]


@concept("predictive", "precision")
def precision(df: DataFrame, label: str, prediction: str) -> float:
    c = _cells(df, label, prediction)
    return _share(c["tp"], c["tp"] + c["fp"])


@concept("predictive", "recall")
def recall(df: DataFrame, label: str, prediction: str) -> float:
    c = _cells(df, label, prediction)
    return _share(c["tp"], c["tp"] + c["fn"])


@concept("predictive", "specificity")
def specificity(df: DataFrame, label: str, prediction: str) -> float:
    c = _cells(df, label, prediction)
    return _share(c["tn"], c["tn"] + c["fp"])


@concept("predictive", "f1-score")
def f1(df: DataFrame, label: str, prediction: str) -> float:
    c = _cells(df, label, prediction)
    return _share(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"])


@concept("predictive", "confusion-matrix")
def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).count()


@concept("predictive", "brier-score")
def brier(df: DataFrame, label: str, probability: str) -> float:
    return _row(df, b=F.avg(F.pow(_x(probability) - _x(label), 2)))["b"]


@concept("predictive", "log-loss")
def log_loss(df: DataFrame, label: str, probability: str) -> float:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), _x(probability)))
    return _row(df, l=-F.avg(_x(label) * F.ln(p) + (1 - _x(label)) * F.ln(1 - p)))["l"]


def _errors(df: DataFrame, actual: str, predicted: str) -> dict:
    e = _x(predicted) - _x(actual)
    return _row(df, mae=F.avg(F.abs(e)), mse=F.avg(e * e), mape=F.avg(F.abs(e / F.nullif(_x(actual), F.lit(0.0)))))


@concept("predictive", "mae")
def mae(df: DataFrame, actual: str, predicted: str) -> float:
    return _errors(df, actual, predicted)["mae"]


@concept("predictive", "mse")
def mse(df: DataFrame, actual: str, predicted: str) -> float:
    return _errors(df, actual, predicted)["mse"]


@concept("predictive", "rmse")
def rmse(df: DataFrame, actual: str, predicted: str) -> float:
    return math.sqrt(_errors(df, actual, predicted)["mse"])


@concept("time series", "mape")
def mape(df: DataFrame, actual: str, predicted: str) -> float:
    return _errors(df, actual, predicted)["mape"]


@concept("predictive", "train-test-split")
def train_test_split(df: DataFrame, share: float = 0.8, seed: int = 0) -> list[DataFrame]:
    return df.randomSplit([share, 1 - share], seed)


@concept("predictive", "stratified-cross-validation")
def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, name: str = "fold") -> DataFrame:
    """Folds by a hash of the key, drawn anew for each class: near equal shares, no shuffle."""
    return df.withColumn(name, F.pmod(F.xxhash64(compat.col(label), compat.col(key)), F.lit(folds)).cast("int"))


@concept("probability", "bayes-theorem")
def bayes(df: DataFrame, event: str, given: str) -> float:
    """P(event | given) of two boolean columns."""
    e, g = compat.col(event).cast("boolean"), compat.col(given).cast("boolean")
    return _row(df, p=F.avg(F.when(g, e.cast("double"))))["p"]


# ---------------------------------------------------------------- regression


@concept("regression", "autocorrelation")
def durbin_watson(df: DataFrame, residual: str, order_by: str) -> float:
    e = _x(residual)
    lagged = ordered.trailing(df.select(e.alias("e"), compat.col(order_by).alias("o")), [F.col("o").asc()], 1, 0, lambda w: F.lag("e").over(w), "before")
    r = _row(lagged, d=F.sum(F.pow(F.col("e") - F.col("before"), 2)), s=F.sum(F.col("e") * F.col("e")))
    return r["d"] / r["s"]


@concept("regression", "box-cox")
def box_cox(df: DataFrame, column: str, lambdas=None) -> dict:
    """The power of a grid with the greatest likelihood; one pass."""
    grid = [round(-2 + 0.1 * i, 1) for i in range(41)] if lambdas is None else list(lambdas)
    x = _x(column)
    moved = lambda k: F.ln(x) if k == 0 else (F.pow(x, F.lit(float(k))) - 1) / k
    r = _row(df.filter(x > 0), n=F.count(x), logs=F.sum(F.ln(x)), **{f"v{i}": F.var_pop(moved(k)) for i, k in enumerate(grid)})
    fit = {k: -r["n"] / 2 * math.log(r[f"v{i}"]) + (k - 1) * r["logs"] for i, k in enumerate(grid) if r[f"v{i}"]}
    best = max(fit, key=fit.get)
    return {"lambda": best, "log_likelihood": fit[best]}


@concept("regression", "ci-for-coefficients")
def coefficient_intervals(df: DataFrame, y: str, x, level: float = 0.95) -> dict:
    r = A.regression_ols(df, y, x)
    t = D.t_quantile(1 - level, r["n"] - len(r["coefficients"]))
    return {k: (b - t * r["std_errors"][k], b + t * r["std_errors"][k]) for k, b in r["coefficients"].items()}


@concept("regression", "dummy-variables")
def dummies(df: DataFrame, column: str, values: list, drop_first: bool = False) -> DataFrame:
    return df.withColumns({f"{column}_{v}": (compat.col(column) == F.lit(v)).cast("int") for v in values[int(drop_first) :]})


@concept("regression", "heteroscedasticity")
def breusch_pagan(df: DataFrame, y: str, x) -> dict:
    r = residuals(df, y, x)
    aux = A.regression_ols(r.withColumn("__e2", F.col("residual") * F.col("residual")), "__e2", x)
    lm, k = aux["n"] * aux["r_squared"], len(compat.names(x))
    return {"lm_statistic": lm, "p_value": D.chi2_sf(lm, k)}


@concept("regression", "interaction-terms")
def interaction(df: DataFrame, x: str, y: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{x}_{y}", _x(x) * _x(y))


@concept("regression", "polynomial-regression")
def polynomial(df: DataFrame, y: str, x: str, degree: int = 2) -> dict:
    own = df.withColumns({f"__p{k}": F.pow(_x(x), F.lit(float(k))) for k in range(1, degree + 1)})
    return A.regression_ols(own, y, [f"__p{k}" for k in range(1, degree + 1)])


@concept("regression", "residual-analysis")
def residuals(df: DataFrame, y: str, x) -> DataFrame:
    b = A.regression_ols(df, y, x)["coefficients"]
    fit = reduce(operator.add, [F.lit(b[c]) * _x(c) for c in compat.names(x)], F.lit(b["const"]))
    return df.withColumn("fitted", fit).withColumn("residual", _x(y) - F.col("fitted"))


@concept("regression", "transformations-log")
def log_transform(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{column}_log", F.log1p(_x(column)))


# ---------------------------------------------------------------- time series


@concept("time series", "acf")
def acf(df: DataFrame, column: str, order_by: str, lags: int = 10) -> list[float]:
    """Autocorrelations from one pass over rows that carry their last values."""
    own = df.select(_x(column).alias("v"), compat.col(order_by).alias("o"))
    m = _row(own, m=F.avg("v"))["m"]
    back = ordered.trailing(own, [F.col("o").asc()], lags, 0, lambda w: F.array(*[F.lag("v", k).over(w) for k in range(lags + 1)]), "b")
    d = F.col("v") - F.lit(m)
    r = _row(back, **{f"c{k}": F.sum(d * (F.col("b")[k] - F.lit(m))) for k in range(lags + 1)})
    return [r[f"c{k}"] / r["c0"] for k in range(lags + 1)]


@concept("time series", "pacf")
def pacf(df: DataFrame, column: str, order_by: str, lags: int = 10) -> list[float]:
    """Durbin and Levinson's recursion on the autocorrelations."""
    r, out, phi = acf(df, column, order_by, lags), [1.0], []
    for k in range(1, lags + 1):
        last = (r[k] - sum(p * r[k - 1 - i] for i, p in enumerate(phi))) / (1 - sum(p * r[i + 1] for i, p in enumerate(phi)))
        phi = [p - last * q for p, q in zip(phi, reversed(phi))] + [last]
        out.append(last)
    return out


@concept("time series", "decomposition")
def decomposition(df: DataFrame, column: str, order_by: str, period: int) -> DataFrame:
    """Additive: a centred moving mean, seasonal means of what is left, and the rest."""
    from .operators.rows import add_index_column

    own = add_index_column(df.select(_x(column).alias("value"), compat.col(order_by).alias("o")), name="i", start=0, order_by="o")
    half = period // 2
    weights = F.avg("value") if period % 2 else None

    def centred(w: W):
        if weights is not None:
            return weights.over(w.rowsBetween(-half, half))
        return (F.avg("value").over(w.rowsBetween(-half, half - 1)) + F.avg("value").over(w.rowsBetween(-half + 1, half))) / 2

    full = ordered.trailing(own, [F.col("i").asc()], half, half, lambda w: F.when(F.lag("i", half).over(w).isNotNull() & F.lead("i", half).over(w).isNotNull(), centred(w)), "trend")
    full = full.withColumn("season", F.col("i") % period)
    means = full.groupBy("season").agg(F.avg(F.col("value") - F.col("trend")).alias("s"))
    level = means.agg(F.avg("s").alias("l"))
    seasonal = means.crossJoin(F.broadcast(level)).select("season", (F.col("s") - F.col("l")).alias("seasonal"))
    return full.join(seasonal, "season").withColumn("remainder", F.col("value") - F.col("trend") - F.col("seasonal")).drop("season", "o")


def _chained(slope: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's line of the value before the first row, from its line of the row before: lines of 1, 2, 4, ... rows are put together.

    What isn't a number makes the rest of its series none; a slope of 0 starts a series.
    """
    n, row = len(base), np.arange(len(base))
    start = np.maximum.accumulate(np.where(slope == 0, row, -1))
    bad = np.maximum.accumulate(np.where(np.isnan(base), row, -1))
    a, b, step = slope.copy(), np.nan_to_num(base), 1
    while step < n:
        b[step:] = b[step:] + a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, np.where((bad >= 0) & (bad >= start), np.nan, b)


@concept("time series", "exponential-smoothing")
def exponential_smoothing(df: DataFrame, column: str, order_by: str, by: list[str], alpha: float = 0.3, name: str = "smoothed", block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Simple smoothing of each series: (by, order_by, column, name).

    A row's value is a straight line of the one before it, and so is a block's last
    value of the value carried into the block: blocks of rows give their lines,
    these are chained (a row for each block), and each block is smoothed from
    what is carried in.  A null makes the rest of its series null.
    """
    share_package(df.sparkSession)
    own = df.select(*compat.cols(by), compat.col(order_by).alias(order_by), _x(column).alias(column))
    keys = compat.cols(by)
    rows = ordered.with_index(own, [*[k.asc() for k in keys], compat.col(order_by).asc()], "__i")
    rows = rows.withColumns({"__block": F.expr(f"__i div {block_rows}"), "__series": F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})})

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        s = pdf["__series"].to_numpy()
        return np.concatenate([[False], s[1:] != s[:-1]])

    def lines_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the slope and base of its value as a line of what is carried into the block."""
        x, new = pdf[column].to_numpy(float), starts(pdf)
        slope, base = _chained(np.where(new, 0.0, 1 - alpha), np.where(new, x, alpha * x))
        return slope, base

    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        slope, base = lines_of(pdf)
        first = float(pdf[column].to_numpy(float)[0])
        return pd.DataFrame({"block": [int(pdf["__block"].iloc[0])], "slope": [slope[-1]], "base": [base[-1]], "first": [pdf["__series"].iloc[0]], "last": [pdf["__series"].iloc[-1]], "x": [first]})

    lines = rows.groupBy("__block").applyInPandas(line, "block long, slope double, base double, first string, last string, x double").orderBy("block").collect()
    carried, before, value = {}, None, math.nan
    for r in lines:
        nan = lambda v: math.nan if v is None else v
        inside = value if r.first == before else nan(r.x)  # a first value is its own predecessor
        carried[r.block] = inside
        value, before = (nan(r.slope) * inside if r.slope else 0.0) + nan(r.base), r.last
    shared = df.sparkSession.createDataFrame(list(carried.items()) or [(0, 0.0)], "__block long, __carried double")

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        slope, base = lines_of(pdf)
        carried = float(pdf["__carried"].iloc[0])
        own = np.maximum.accumulate(starts(pdf))  # rows of a series that starts in this block
        return pd.DataFrame({"__i": pdf["__i"], "__smoothed": np.where(own, base, slope * carried + base)})

    done = rows.join(shared, "__block").select("__i", "__block", "__series", "__carried", column).groupBy("__block").applyInPandas(smooth, "__i long, __smoothed double")
    smoothed = F.when(~F.isnan("__smoothed"), F.col("__smoothed")).alias(name)
    return rows.join(done, "__i").select(*keys, compat.col(order_by), compat.col(column), smoothed)


# ---------------------------------------------------------------- data for charts


@concept("eda", "bar-chart")
def bar_chart(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count()


@concept("eda", "histogram")
def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    x = _x(column)
    edge = F.broadcast(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    share = F.try_divide(x - F.col("lo"), F.col("hi") - F.col("lo")) * bins  # width_bucket multiplies first, and rounds some edges' values to the bin before
    bucket = F.least(F.when(~F.isnan(share), F.floor(share) + 1), F.lit(bins).cast("long"))
    return df.filter(x.isNotNull()).crossJoin(edge).groupBy(bucket.alias("bin"), (F.col("lo") + (bucket - 1) * (F.col("hi") - F.col("lo")) / bins).alias("start")).count()


@concept("eda", "box-plot")
def box_plot(df: DataFrame, column: str) -> dict:
    q = A._quantiles(df, _x(column), 0.0, 0.25, 0.5, 0.75, 1.0)
    return dict(zip(("min", "q1", "median", "q3", "max"), q))


@concept("eda", "density-plot")
def density(df: DataFrame, column: str, points: int = 64) -> dict:
    """A Gaussian kernel density from the counts of a fine histogram."""
    r = _row(df, s=F.stddev_samp(_x(column)), n=F.count(_x(column)), lo=F.min(_x(column)), hi=F.max(_x(column)))
    h = 1.06 * r["s"] * r["n"] ** -0.2
    bars = histogram(df, column, 512).orderBy("bin").collect()
    width = (r["hi"] - r["lo"]) / 512
    mids, counts = np.array([b.start + width / 2 for b in bars]), np.array([b["count"] for b in bars], float)
    at = np.linspace(mids[0], mids[-1], points)
    k = np.exp(-0.5 * ((at[:, None] - mids) / h) ** 2) / (h * math.sqrt(2 * math.pi))
    return {"x": at.tolist(), "density": ((k * counts).sum(1) / counts.sum()).tolist()}


@concept("eda", "line-chart")
def line_chart(df: DataFrame, x: str, y: str, fn=F.avg) -> DataFrame:
    return df.groupBy(x).agg(fn(_x(y)).alias(y)).orderBy(x)


@concept("eda", "pair-plot")
def pair_plot(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """(x, y, bin_x, bin_y, count) of every two columns, each cut into bins of equal width: the pairs' pictures from all rows."""
    values = df.select(*[F.when(~F.isnan(_x(c)), _x(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    edges = values.agg(*[f(f"v{i}").alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("lo", F.min), ("hi", F.max))])
    own = values.crossJoin(F.broadcast(edges))  # one row
    place = [F.when(F.col(f"v{i}").isNotNull(), F.least(F.floor((F.col(f"v{i}") - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}")) * bins) + 1, F.lit(bins))).cast("int") for i in range(len(columns))]
    binned = own.select(*[p.alias(f"b{i}") for i, p in enumerate(place)])
    pairs = [F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), F.col(f"b{i}").alias("bin_x"), F.col(f"b{j}").alias("bin_y")) for i in range(len(columns)) for j in range(i)]
    # one count of the distinct combinations, then of each pair
    counted = binned.groupBy(*binned.columns).agg(F.count("*").alias("n"))
    each = counted.select("n", F.explode(F.array(*pairs)).alias("p")).filter("p.bin_x is not null and p.bin_y is not null")
    return each.groupBy("p.x", "p.y", "p.bin_x", "p.bin_y").agg(F.sum("n").alias("count"))


@concept("eda", "scatter-plot")
def scatter(df: DataFrame, columns: list[str], rows: int = 1000, seed: int = 0) -> DataFrame:
    """A random sample to draw."""
    return df.select(*compat.cols(columns)).orderBy(F.rand(seed)).limit(rows)
