"""Queries for the statistical concepts, sources and probabilities, with independent DuckDB SQL.

Tails of distributions are integrated in SQL by Simpson's rule, or in closed
form where the degrees of freedom allow one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import concepts
from .concepts import CONCEPTS
from .operators import ordered
from .queries import LABELLED, ORACLES, QUERIES, rounded, table
from .sources import io
from .stats import analyse

#: Source frames: a table and expressions that Spark and DuckDB read alike.
SOURCES: dict[str, tuple[str, list[str]]] = {
    "scored": ("lineitem", ["cast(l_returnflag = 'R' as int) AS y", "cast(l_quantity > 25 as int) AS p", "l_discount * 10 AS prob",
        "l_extendedprice / 1000 AS actual", "l_quantity * 1.5 AS predicted", "l_tax AS tax", "l_quantity AS q", "l_discount AS d", "l_returnflag AS flag"]),
    "priced": ("orders", ["o_orderkey AS k", "o_totalprice / 100000 AS price", "o_orderstatus AS status", "cast(o_orderpriority = '1-URGENT' as boolean) AS urgent",
        "cast(o_orderstatus = 'F' as boolean) AS done"]),
    "tested": ("customer", ["c_custkey AS k", "cast(c_custkey % 997 + 1 as double) / 998 AS p", "c_acctbal / 1000 AS balance", "c_mktsegment AS segment", "c_nationkey AS nation"]),
    "parts": ("part", ["p_partkey AS k", "p_size AS size", "p_retailprice / 1000 AS price", "p_partkey % 7 AS seven"]),
    "series": ("events", ["event_id AS id", "ts", "user_id AS u", "event_type AS kind", "value AS v"]),
}


def _sql_source(name: str) -> str:
    base, exprs = SOURCES[name]
    return f"(SELECT {', '.join(exprs)} FROM {base})"


def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, exprs = SOURCES[name]
    return table(spark, sf_dir, base).selectExpr(*exprs)


def _numbers(value, prefix: str = "") -> Iterable[tuple[str, float]]:
    """(measure, value) of a number, a list, a pair or a dictionary of such."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _numbers(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            yield from _numbers(v, f"{prefix}.{i}" if prefix else str(i))
    elif isinstance(value, (int, float)):
        yield prefix or "value", float(value)


def measures(sql: str, *keys: str, digits: int = 4) -> str:
    """SQL of one row to (measure, value) rows."""
    named = ", ".join(f'"{k}"' for k in keys)
    rows = (f"SELECT '{k}' AS measure, round((\"{k}\")::DOUBLE, {digits}) AS value FROM s" for k in keys)
    return f"WITH s({named}) AS ({sql}) " + " UNION ALL ".join(rows)


def add(name: str, source: str | None, run: Callable, sql: str | None, digits: int = 4, keys: tuple[str, ...] = ()) -> None:
    """Register ``run`` of the source frame (or of nothing): numbers become (measure, value) rows.

    ``keys`` keeps some measures only, those that SQL states.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = run(_frame(spark, sf_dir, source)) if source else run()
        if not isinstance(found, DataFrame):
            rows = [r for r in _numbers(found) if not keys or r[0] in keys]
            found = spark.createDataFrame(rows, "measure string, value double")
        return rounded(found, digits)

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLES[name] = " ".join(sql.split())


def concept(slug: str, source: str | None, args: tuple, sql: str | None, *, digits: int = 4, keys: tuple[str, ...] = (), named: dict | None = None, after: Callable | None = None) -> None:
    """Register a concept's own function."""
    fn, more = CONCEPTS[slug].run, named or {}
    finish = after or (lambda x: x)
    name = "concept_" + slug.replace("-", "_")
    run = (lambda df: finish(fn(df, *args, **more))) if source else (lambda: finish(fn(*args, **more)))
    add(name, source, run, sql, digits, keys)


def value_of(expr: str, source: str, digits: int = 4) -> str:
    return f"SELECT 'value' AS measure, round(({expr})::DOUBLE, {digits}) AS value FROM {_sql_source(source)}"


def simpson(f: str, low: str, high: str, steps: int = 2000) -> str:
    """A scalar subquery: the integral of ``f`` (of t) from ``low`` to ``high``."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT (any_value(b) - any_value(a)) / {3 * steps} * sum(({weight}) * ({f})) FROM (SELECT a, b, i, a + (b - a) * i / {steps} AS t FROM (SELECT ({low})::DOUBLE AS a, ({high})::DOUBLE AS b), range({steps + 1}) r(i)))"


def normal_cdf(z: str) -> str:
    return f"(0.5 + {simpson('exp(-t * t / 2) / sqrt(2 * pi())', '0', z)})"


def t_two_sided(t: str, dof: str) -> str:
    """1 less the mass within |t|; the density's constant by logarithms of gamma."""
    return f"greatest(0, 1 - 2 * exp(lgamma((({dof}) + 1) / 2.0) - lgamma(({dof}) / 2.0)) / sqrt(({dof}) * pi()) * " + simpson(f"pow(1 + t * t / ({dof}), -(({dof}) + 1) / 2.0)", "0", f"abs({t})") + ")"


#: The normal quantile of 0.975; a fixed value.
Z = "1.959963984540054"
T = f"({Z} + (pow({Z}, 3) + {Z}) / (4 * dof) + (5 * pow({Z}, 5) + 16 * pow({Z}, 3) + 3 * {Z}) / (96 * dof * dof))"

# ------------------------------------------------------------------ descriptions and correlation

concept("coefficient-of-variation", "scored", ("actual",), value_of("stddev_samp(actual) / avg(actual)", "scored"))
concept("mad", "scored", ("actual",), f"SELECT 'value' AS measure, round(median(abs(actual - m)), 4) AS value FROM {_sql_source('scored')}, (SELECT median(actual) AS m FROM {_sql_source('scored')})")
concept("range", "scored", ("actual",), value_of("max(actual) - min(actual)", "scored"))
concept("multicollinearity", "scored", (["actual", "q"],), f"SELECT m AS measure, round(1 / (1 - r * r), 4) AS value FROM (SELECT corr(actual, q) AS r FROM {_sql_source('scored')}), (VALUES ('actual'), ('q')) v(m)")
concept("partial-correlation", "scored", ("actual", "tax", ["q"]),
    f"SELECT 'value' AS measure, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 4) AS value FROM (SELECT corr(actual, tax) AS xy, corr(actual, q) AS xz, corr(tax, q) AS yz FROM {_sql_source('scored')})")

# ------------------------------------------------------------------ estimation and tests

add("concept_bootstrapping", "priced", lambda df: df.agg(F.count("price").alias("n"), F.avg("price").alias("mean")).crossJoin(df.sparkSession.createDataFrame([CONCEPTS["bootstrapping"].run(df, "price")]))
    .select("n", "mean", F.expr("low < mean and mean < high").alias("covered"), F.expr("abs(high - low) < 8 * std_error").alias("narrow")),
    f"SELECT count(*) AS n, round(avg(price), 4) AS mean, TRUE AS covered, TRUE AS narrow FROM {_sql_source('priced')}")
concept("permutation-tests", "priced", ("price", "urgent"), f"SELECT 'difference' AS measure, round(avg(price) FILTER (urgent) - avg(price) FILTER (NOT urgent), 4) AS value FROM {_sql_source('priced')}", keys=("difference",))
_MEAN = f"(SELECT avg(price) AS m, stddev_samp(price) / sqrt(count(*)) AS se, count(*) - 1 AS dof FROM {_sql_source('priced')})"
for _slug in ("ci-mean", "confidence-intervals"):
    concept(_slug, "priced", ("price",), measures(f"SELECT m, m - {T} * se, m + {T} * se FROM {_MEAN}", "mean", "low", "high"))
concept("ci-proportion", "priced", ("urgent",), measures(
    f"""SELECT p, (p + z2 / (2 * n) - h) / (1 + z2 / n), (p + z2 / (2 * n) + h) / (1 + z2 / n) FROM (SELECT p, n, z2, sqrt(z2) * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) AS h
    FROM (SELECT avg(urgent::INT) AS p, count(*) AS n, {Z} * {Z} AS z2 FROM {_sql_source('priced')}))""", "proportion", "low", "high"))
concept("sampling-methods", "priced", ("status", {"F": 0.5, "O": 0.1}), None)
concept("bonferroni", "tested", ("p",), f"SELECT k, round(p, 6) AS p, round(balance, 6) AS balance, segment, nation, round(least(1, p * n), 6) AS p_adjusted FROM {_sql_source('tested')}, (SELECT count(*) AS n FROM customer)", digits=6)
concept("fdr", "tested", ("p",), f"""SELECT k, round(p_adjusted, 6) AS p_adjusted FROM (SELECT k, least(1, min(p * n / r) OVER (ORDER BY r DESC)) AS p_adjusted
    FROM (SELECT k, p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r FROM {_sql_source('tested')}), (SELECT count(*) AS n FROM customer))""",
    digits=6, after=lambda df: df.select("k", "p_adjusted"))
concept("effect-size", "scored", ("actual", "predicted"), value_of("(avg(actual) - avg(predicted)) / sqrt((var_samp(actual) + var_samp(predicted)) / 2)", "scored"))
_FISHER = f"""(SELECT count(*) FILTER (urgent AND done) AS a, count(*) FILTER (urgent AND NOT done) AS b, count(*) FILTER (NOT urgent AND done) AS c, count(*) FILTER (NOT urgent AND NOT done) AS d FROM {_sql_source('priced')})"""
_LOG = "lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)"
concept("fishers-exact-test", "priced", ("urgent", "done"), f"""SELECT 'odds_ratio' AS measure, round(a * d / (b * c), 4) AS value FROM {_FISHER} UNION ALL SELECT 'p_value', round(least(1, sum(exp(l - m)) FILTER (l <= lr + 1e-7) / sum(exp(l - m))), 4)
    FROM (SELECT *, max(l) OVER () AS m, max(l) FILTER (k = a) OVER () AS lr FROM (SELECT *, {_LOG} AS l FROM (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM {_FISHER})))""")
_WELCH = f"(SELECT segment AS g, count(balance) AS n, avg(balance) AS m, var_samp(balance) AS v FROM {_sql_source('tested')} GROUP BY 1)"
concept("post-hoc-tests", "tested", ("balance", "segment"), f"""SELECT x.g AS a, y.g AS b, round((x.m - y.m) / sqrt(x.v / x.n + y.v / y.n), 4) AS t_statistic FROM {_WELCH} x, {_WELCH} y WHERE x.g < y.g""", after=lambda df: df.select("a", "b", "t_statistic"))


def _of_groups(name: str, source: str, run: Callable[[DataFrame], DataFrame], sql: str, digits: int = 6) -> None:
    """A query that judges a statistic of each group of a table."""
    QUERIES[name] = lambda spark, sf_dir: rounded(run(table(spark, sf_dir, source)), digits)
    ORACLES[name] = " ".join(sql.split())


_LINES = lambda df: df.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"))
_LINES_SQL = "(SELECT l_linenumber, count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1)"
_Z_OF = lambda df: concepts.p_values(_LINES(df).withColumn("z", (F.col("m") - 25.4) / (F.col("s") / F.sqrt("n"))), "z")
_Z_SQL = f"(SELECT l_linenumber, z, 2 - 2 * {normal_cdf('abs(z)')} AS p FROM (SELECT l_linenumber, (m - 25.4) / (s / sqrt(n)) AS z FROM {_LINES_SQL}))"
_of_groups("concept_sample_size", "lineitem", lambda df: concepts.sample_sizes(_LINES(df), "s", 0.5).select("l_linenumber", "sample_size"), f"SELECT l_linenumber, ceil(pow({Z} * s / 0.5, 2))::BIGINT AS sample_size FROM {_LINES_SQL}")
_of_groups("concept_power", "lineitem", lambda df: concepts.powers(_LINES(df).withColumn("e", (F.col("m") - 25) / F.col("s")), "e", "n").select("l_linenumber", "power"),
    f"SELECT l_linenumber, round(1 - {normal_cdf(f'least(12, greatest(-12, {Z} - x))')} + {normal_cdf(f'least(12, greatest(-12, -{Z} - x))')}, 4) AS power FROM (SELECT l_linenumber, (m - 25) / s * sqrt(n) AS x FROM {_LINES_SQL})", 4)
_of_groups("concept_significance_level", "lineitem", lambda df: concepts.significant(_Z_OF(df), "p_value", 0.9).select("l_linenumber", "significant"), f"SELECT l_linenumber, p <= 0.1 AS significant FROM {_Z_SQL}")
_of_groups("concept_p_value", "lineitem", lambda df: _Z_OF(df).select("l_linenumber", "p_value"), f"SELECT l_linenumber, round(p, 6) AS p_value FROM {_Z_SQL}")


def _t_of(lines: int) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        g = df.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s")).filter((F.col("n") == lines) & (F.col("s") > 0))
        return concepts.p_values(g.withColumns({"t": (F.col("m") - 25) / (F.col("s") / F.sqrt("n")), "d": F.col("n") - 1}), "t", "t", "d").select("l_orderkey", "p_value")

    return run


_T_SQL = lambda lines, p: f"SELECT l_orderkey, round({p}, 6) AS p_value FROM (SELECT l_orderkey, (avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))) AS t FROM lineitem GROUP BY 1 HAVING count(*) = {lines} AND stddev_samp(l_quantity) > 0)"
_of_groups("concept_p_value_t", "lineitem", _t_of(3), _T_SQL(3, "1 - abs(t) / sqrt(2 + t * t)"))
# seven lines, six degrees of freedom: a closed form as well
_of_groups("concept_p_value_t_7", "lineitem", _t_of(7), _T_SQL(7, "1 - (abs(t) / sqrt(6 + t * t)) * (1 + 0.5 * 6 / (6 + t * t) + 0.375 * pow(6 / (6 + t * t), 2))"))


def _chi_of(df: DataFrame) -> DataFrame:
    cells = [F.count(F.when(F.col("l_linenumber") == i, 1)).alias(f"c{i}") for i in range(1, 6)]
    g = df.groupBy("l_suppkey").agg(*cells)
    total = sum((F.col(f"c{i}") for i in range(2, 6)), F.col("c1"))
    chi = sum((F.pow(F.col(f"c{i}") - total / 5, F.lit(2.0)) for i in range(2, 6)), F.pow(F.col("c1") - total / 5, F.lit(2.0))) / (total / 5)
    return concepts.p_values(g.filter(total > 0).withColumn("x", chi), "x", "chi2", 4).select("l_suppkey", "p_value")


_of_groups("concept_p_value_chi2", "lineitem", _chi_of, """SELECT l_suppkey, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value FROM (SELECT l_suppkey, sum(n * n) * 5 / sum(n) - sum(n) AS x
    FROM (SELECT l_suppkey, l_linenumber, count(*)::DOUBLE AS n FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL) GROUP BY 1)""")


def _f_of(df: DataFrame) -> DataFrame:
    g = df.groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"), F.avg("l_tax").alias("m"), F.var_samp("l_tax").alias("v"))
    f = g.groupBy("l_linenumber").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"))
    f = f.withColumns({"d": F.col("n") - 3, "f": (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / 2 / (F.col("w") / (F.col("n") - 3))})
    return concepts.p_values(f, "f", "f", (2, "d")).select("l_linenumber", "p_value")


_of_groups("concept_p_value_f", "lineitem", _f_of, """SELECT l_linenumber, round(pow(1 + 2 * f / d, -d / 2), 6) AS p_value FROM (SELECT l_linenumber, sum(n) - 3 AS d, (sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / 2 / (sum((n - 1) * v) / (sum(n) - 3)) AS f
    FROM (SELECT l_linenumber, l_returnflag, count(*)::DOUBLE AS n, avg(l_tax) AS m, var_samp(l_tax) AS v FROM lineitem GROUP BY ALL) GROUP BY 1)""")
concept("z-test", "tested", ("balance", 4.5), measures(
    f"SELECT z, 2 - 2 * {normal_cdf('least(abs(z), 12)')}, n FROM (SELECT (avg(balance) - 4.5) / (stddev_samp(balance) / sqrt(count(*))) AS z, count(*) AS n FROM {_sql_source('tested')})", "z_statistic", "p_value", "n"))

# ------------------------------------------------------------------ predictions

_Y = ("y", "p")
_N = lambda y, p: f"count(*) FILTER (y = {y} AND p = {p})"
concept("accuracy", "scored", _Y, value_of("avg((y = p)::INT)", "scored", 6), digits=6)
concept("precision", "scored", _Y, value_of(f"{_N(1, 1)} / count(*) FILTER (p = 1)", "scored", 6), digits=6)
concept("recall", "scored", _Y, value_of(f"{_N(1, 1)} / count(*) FILTER (y = 1)", "scored", 6), digits=6)
concept("specificity", "scored", _Y, value_of(f"{_N(0, 0)} / count(*) FILTER (y = 0)", "scored", 6), digits=6)
concept("f1-score", "scored", _Y, value_of(f"2 * {_N(1, 1)} / (2 * {_N(1, 1)} + {_N(0, 1)} + {_N(1, 0)})", "scored", 6), digits=6)
concept("confusion-matrix", "scored", _Y, f"SELECT y, p, count(*) AS count FROM {_sql_source('scored')} GROUP BY ALL")
concept("brier-score", "scored", ("y", "prob"), value_of("avg(pow(prob - y, 2))", "scored", 6), digits=6)
_P = "greatest(1e-15, least(1 - 1e-15, prob))"
concept("log-loss", "scored", ("y", "prob"), value_of(f"-avg(y * ln({_P}) + (1 - y) * ln(1 - {_P}))", "scored"))
_E = ("actual", "predicted")
concept("mae", "scored", _E, value_of("avg(abs(predicted - actual))", "scored"))
concept("mse", "scored", _E, value_of("avg(pow(predicted - actual, 2))", "scored"))
concept("rmse", "scored", _E, value_of("sqrt(avg(pow(predicted - actual, 2)))", "scored"))
concept("mape", "scored", _E, value_of("avg(abs((predicted - actual) / nullif(actual, 0)))", "scored"))
concept("stratified-cross-validation", "scored", ("flag", "actual"), f"SELECT flag, count(*) AS n, 5 AS folds, TRUE AS even FROM {_sql_source('scored')} GROUP BY 1",
    after=lambda df: df.groupBy("flag", "fold").agg(F.count("*").alias("c")).groupBy("flag").agg(F.sum("c").alias("n"), F.count("*").cast("int").alias("folds"), (F.max("c") < 1.25 * F.min("c")).alias("even")))
concept("train-test-split", "parts", (0.8,), f"SELECT count(*) AS n, count(DISTINCT k) AS keys, 0 AS doubled FROM {_sql_source('parts')}",
    after=lambda halves: halves[0].withColumn("part", F.lit("train")).unionByName(halves[1].withColumn("part", F.lit("test"))).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("part").alias("p"))
    .agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.count(F.when(F.col("p") > 1, 1)).cast("int").alias("doubled")))
concept("bayes-theorem", "priced", ("urgent", "done"), value_of("avg(urgent::INT) FILTER (done)", "priced", 6), digits=6)

# ------------------------------------------------------------------ regression

_FIT = f"(SELECT regr_slope(actual, q) AS b, regr_intercept(actual, q) AS a, count(*) - 2 AS dof, sqrt((1 - regr_r2(actual, q)) * var_pop(actual) / var_pop(q) / (count(*) - 2)) AS sb, sqrt((1 - regr_r2(actual, q)) * var_pop(actual) * (1 + avg(q) * avg(q) / var_pop(q)) / (count(*) - 2)) AS sa FROM {_sql_source('scored')})"
concept("ci-for-coefficients", "scored", ("actual", ["q"]), measures(f"SELECT a - {T} * sa, a + {T} * sa, b - {T} * sb, b + {T} * sb FROM {_FIT}", "const.0", "const.1", "q.0", "q.1"))
_RES = f"(SELECT q, actual, a + b * q AS fitted, actual - a - b * q AS residual FROM {_sql_source('scored')}, {_FIT})"
concept("residual-analysis", "scored", ("actual", ["q"]), f"SELECT round(q, 4) AS q, round(fitted, 4) AS fitted, round(residual, 4) AS residual FROM {_RES}", after=lambda df: df.select("q", "fitted", "residual"))
concept("heteroscedasticity", "scored", ("actual", ["q"]), measures(f"SELECT count(*) * regr_r2(residual * residual, q) FROM {_RES}", "lm_statistic", digits=3), digits=3, keys=("lm_statistic",))
concept("autocorrelation", "series", ("v", "ts"), f"SELECT 'value' AS measure, round(sum(pow(v - b, 2)) / sum(v * v), 4) AS value FROM (SELECT v, lag(v) OVER (ORDER BY ts) AS b FROM {_sql_source('series')})")
_BC = f"""(SELECT k, -count(*) / 2 * ln(var_pop(CASE WHEN k = 0 THEN ln(price) ELSE (pow(price, k) - 1) / k END)) + (k - 1) * sum(ln(price)) AS l FROM (SELECT price, round(-2 + 0.1 * i, 1)::DOUBLE AS k FROM {_sql_source('priced')}, range(41) r(i) WHERE price > 0) GROUP BY k)"""
concept("box-cox", "priced", ("price",), f"SELECT 'lambda' AS measure, arg_max(k, l) AS value FROM {_BC} UNION ALL SELECT 'log_likelihood', round(max(l), 2) FROM {_BC}", digits=2)
concept("dummy-variables", "priced", ("status", ["F", "O", "P"], True), f"SELECT k, (status = 'O')::INT AS \"status_O\", (status = 'P')::INT AS \"status_P\" FROM {_sql_source('priced')}", after=lambda df: df.select("k", "status_O", "status_P"))
concept("interaction-terms", "parts", ("size", "price"), f"SELECT k, round(size * price, 4) AS size_price FROM {_sql_source('parts')}", after=lambda df: df.select("k", "size_price"))
_C = "SELECT covar_pop(q, actual) AS s1y, covar_pop(q * q, actual) AS s2y, var_pop(q) AS s11, var_pop(q * q) AS s22, covar_pop(q, q * q) AS s12, avg(actual) AS my, avg(q) AS m1, avg(q * q) AS m2"
_POLY = f"(SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM ({_C} FROM {_sql_source('scored')}))"
concept("polynomial-regression", "scored", ("actual", "q"), measures(f"SELECT my - b1 * m1 - b2 * m2, b1, b2 FROM {_POLY}", "coefficients.const", "coefficients.__p1", "coefficients.__p2"), keys=("coefficients.const", "coefficients.__p1", "coefficients.__p2"))
concept("transformations-log", "parts", ("size",), f"SELECT k, round(ln(1 + size), 6) AS size_log FROM {_sql_source('parts')}", digits=6, after=lambda df: df.select("k", "size_log"))

# ------------------------------------------------------------------ time series

_ACF = lambda k: f"(SELECT sum((v - m) * (b - m)) / sum((v - m) * (v - m)) FROM (SELECT v, lag(v, {k}) OVER (ORDER BY ts) AS b FROM {_sql_source('series')}), (SELECT avg(v) AS m FROM {_sql_source('series')}))"
concept("acf", "series", ("v", "ts", 3), " UNION ALL ".join(f"SELECT '{k}' AS measure, round({_ACF(k)}, 6) AS value" for k in range(4)), digits=6)
concept("pacf", "series", ("v", "ts", 2), f"SELECT '0' AS measure, 1::DOUBLE AS value UNION ALL SELECT '1', round({_ACF(1)}, 6) UNION ALL SELECT '2', round(({_ACF(2)} - pow({_ACF(1)}, 2)) / (1 - pow({_ACF(1)}, 2)), 6)", digits=6)
_TREND = f"""(SELECT i, v, CASE WHEN i >= 3 AND i < n - 3 THEN avg(v) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend, i % 7 AS season
    FROM (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, v FROM {_sql_source('series')}), (SELECT count(*) AS n FROM events))"""
concept("decomposition", "series", ("v", "ts", 7), f"""SELECT i, round(v, 4) AS value, round(trend, 4) AS trend, round(s - l, 4) AS seasonal, round(v - trend - (s - l), 4) AS remainder FROM {_TREND}
    JOIN (SELECT season, avg(v - trend) AS s FROM {_TREND} GROUP BY 1) USING (season), (SELECT avg(s) AS l FROM (SELECT avg(v - trend) AS s FROM {_TREND} GROUP BY season))""",
    after=lambda df: df.select("i", "value", "trend", "seasonal", "remainder"))
_NUMBERED = f"(SELECT u, ts, v, row_number() OVER (PARTITION BY u ORDER BY ts) AS i FROM {_sql_source('series')})"
concept("exponential-smoothing", "series", ("v", "ts", ["u"], 1 / 3), f"""SELECT y.u, y.ts, round(sum(CASE WHEN x.i = 1 THEN 1::DOUBLE ELSE 1::DOUBLE / 3 END * pow(2::DOUBLE / 3, y.i - x.i) * x.v), 4) AS smoothed
    FROM {_NUMBERED} y JOIN {_NUMBERED} x ON x.u = y.u AND x.i <= y.i GROUP BY y.u, y.ts""", after=lambda df: df.select("u", "ts", "smoothed"))

# ------------------------------------------------------------------ data for charts

concept("bar-chart", "priced", ("status",), f"SELECT status, count(*) AS count FROM {_sql_source('priced')} GROUP BY 1")
concept("box-plot", "scored", ("actual",), measures(f"SELECT min(actual), quantile_cont(actual, 0.25), median(actual), quantile_cont(actual, 0.75), max(actual) FROM {_sql_source('scored')}", "min", "q1", "median", "q3", "max"))
_BIN = lambda x, n: f"least({n}, floor(({x} - lo) / (hi - lo) * {n}) + 1)"
concept("histogram", "series", ("v", 20), f"""SELECT b::BIGINT AS bin, round(lo + (b - 1) * (hi - lo) / 20, 4) AS start, count(*) AS count
    FROM (SELECT lo, hi, {_BIN('v', 20)} AS b FROM {_sql_source('series')}, (SELECT min(v) AS lo, max(v) AS hi FROM {_sql_source('series')})) GROUP BY ALL""")
concept("density-plot", "series", ("v", 8), f"""WITH r AS (SELECT min(v) AS lo, max(v) AS hi, 1.06 * stddev_samp(v) * pow(count(v), -0.2) AS h FROM {_sql_source('series')}),
    b AS (SELECT lo + (b - 0.5) * (hi - lo) / 512 AS m, count(*) AS c FROM (SELECT lo, hi, {_BIN('v', 512)} AS b FROM {_sql_source('series')}, r) GROUP BY ALL),
    g AS (SELECT i, (SELECT min(m) FROM b) + i * ((SELECT max(m) FROM b) - (SELECT min(m) FROM b)) / 7 AS x FROM range(8) t(i)),
    d AS (SELECT i, x, sum(c * exp(-0.5 * ((x - m) / h) ** 2) / (h * sqrt(2 * pi()))) / sum(c) AS y FROM g, b, r GROUP BY ALL)
    SELECT 'x.' || i AS measure, round(x, 4) AS value FROM d UNION ALL SELECT 'density.' || i, round(y, 4) FROM d""")
concept("line-chart", "parts", ("seven", "price"), f"SELECT seven, round(avg(price), 4) AS price FROM {_sql_source('parts')} GROUP BY 1 ORDER BY 1")
concept("scatter-plot", "parts", (["size", "price"], 100), None)
_PLACE = lambda c: f"least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 10) + 1, 10)::INT"
concept("pair-plot", "parts", (["size", "price", "seven"], 10), f"""WITH b AS (SELECT {_PLACE('size')} AS size, {_PLACE('price')} AS price, {_PLACE('seven')} AS seven FROM {_sql_source('parts')})
    SELECT 'price' AS x, 'size' AS y, price AS bin_x, size AS bin_y, count(*) AS count FROM b GROUP BY ALL UNION ALL SELECT 'seven', 'size', seven, size, count(*) FROM b GROUP BY ALL
    UNION ALL SELECT 'seven', 'price', seven, price, count(*) FROM b GROUP BY ALL""")

# ------------------------------------------------------------------ probabilities of the analyses


def _analysis(name: str, source: str, analysis: str, params: dict, keys: tuple[str, ...], sql: str, digits: int = 4) -> None:
    def run(df: DataFrame) -> DataFrame:
        return analyse(df, analysis, params).select("measure", "value").filter(F.col("measure").isin(list(keys)))

    add(f"analysis_{name}", source, run, sql, digits)


_analysis("ttest_1samp_p", "parts", "ttest_1samp", {"column": "size", "popmean": 25.2}, ("p_value",), measures(
    f"SELECT {t_two_sided('t', 'dof')} FROM (SELECT (avg(size) - 25.2) / (stddev_samp(size) / sqrt(count(*))) AS t, count(*) - 1 AS dof FROM {_sql_source('parts')})", "p_value"))
add("analysis_paired_ttest_p", "tested", lambda df: analyse(df.withColumn("shifted", (F.col("nation") + 0.5) / 25), "paired_ttest", {"before": "p", "after": "shifted"}).select("measure", "value").filter("measure = 'p_value'"), measures(
    f"SELECT {t_two_sided('t', 'dof')} FROM (SELECT avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t, count(*) - 1 AS dof FROM (SELECT p - (nation + 0.5) / 25 AS x FROM {_sql_source('tested')}))", "p_value"))
_GROUPS = f"(SELECT status AS g, count(*) AS n, avg(price) AS m, var_pop(price) * count(*) AS w FROM {_sql_source('priced')} GROUP BY 1)"
# three groups: the tail of F with two degrees of freedom has a closed form
_analysis("anova_p", "priced", "anova", {"value": "price", "group": "status"}, ("f_statistic", "p_value"), measures(
    f"SELECT f, pow(1 + 2 * f / d, -d / 2) FROM (SELECT (sum(n * (m - g0) * (m - g0)) / 2) / (sum(w) / (sum(n) - 3)) AS f, sum(n) - 3 AS d FROM {_GROUPS}, (SELECT avg(price) AS g0 FROM {_sql_source('priced')}))", "f_statistic", "p_value"))
_CHI = f"""(SELECT sum(power(coalesce(o, 0) - ra * rb / n, 2) / (ra * rb / n)) AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM (SELECT status AS a, count(*) AS ra FROM {_sql_source('priced')} GROUP BY 1),
    (SELECT urgent AS b, count(*) AS rb FROM {_sql_source('priced')} GROUP BY 1), (SELECT count(*) AS n FROM orders) LEFT JOIN (SELECT status AS sa, urgent AS sb, count(*) AS o FROM {_sql_source('priced')} GROUP BY 1, 2) ON sa = a AND sb = b)"""
_analysis("chi_square_independence_p", "priced", "chi_square_independence", {"column1": "status", "column2": "urgent"}, ("chi2_statistic", "df", "p_value"), measures(f"SELECT x, dof, exp(-x / 2) FROM {_CHI}", "chi2_statistic", "df", "p_value"))
_analysis("kruskal_wallis_p", "priced", "kruskal_wallis", {"value": "price", "group": "status"}, ("h_statistic", "p_value"), measures(
    f"""SELECT h, exp(-h / 2) FROM (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (power(n, 3) - n)) AS h FROM (SELECT sum(s * s / c) AS q FROM (SELECT sum(r) AS s, count(*) AS c FROM (SELECT status, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2 AS r
    FROM {_sql_source('priced')}) GROUP BY status)), (SELECT count(*)::DOUBLE AS n FROM orders), (SELECT sum(power(k, 3) - k) AS t FROM (SELECT count(*)::DOUBLE AS k FROM {_sql_source('priced')} GROUP BY price)))""", "h_statistic", "p_value"))
_analysis("correlation_pearson_p", "parts", "correlation", {"x": "size", "y": "price"}, ("p_value",), measures(
    f"SELECT {t_two_sided('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')} FROM (SELECT corr(size, price) AS r, count(*) AS n FROM {_sql_source('parts')})", "p_value"))
_analysis("normality_measures", "tested", "normality_test", {"column": "balance"}, ("skewness", "kurtosis", "n", "ks_statistic"), f"""
    WITH x AS (SELECT balance AS v FROM {_sql_source('tested')}), m AS (SELECT avg(v) AS m, stddev_samp(v) AS s, var_pop(v) AS p, count(*) AS n FROM x),
    z AS (SELECT row_number() OVER (ORDER BY v) AS i, (v - m) / s AS z FROM x, m),
    c AS (SELECT i, 0.5 + any_value(z) / 600 / sqrt(2 * pi()) * sum(exp(-pow(z * j / 200, 2) / 2) * CASE WHEN j = 0 OR j = 200 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) AS c FROM z, range(201) r(j) GROUP BY i)
    SELECT 'skewness' AS measure, round(avg(pow(v - m, 3)) / pow(any_value(p), 1.5), 4) AS value FROM x, m UNION ALL SELECT 'kurtosis', round(avg(pow(v - m, 4)) / pow(any_value(p), 2) - 3, 4) FROM x, m
    UNION ALL SELECT 'n', n FROM m UNION ALL SELECT 'ks_statistic', round(max(greatest(i / n - c, c - (i - 1) / n)), 4) FROM c, m""")
# one predictor of two values: the likelihood's maximum has a closed form
_analysis("logistic_regression_coefficients", "scored", "logistic_regression", {"y": "y", "x": ["p"]}, ("coefficients.const", "coefficients.p"), measures(
    f"SELECT ln(a / (1 - a)), ln(b / (1 - b)) - ln(a / (1 - a)) FROM (SELECT avg(y) FILTER (p = 0) AS a, avg(y) FILTER (p = 1) AS b FROM {_sql_source('scored')})", "coefficients.const", "coefficients.p"))

# ------------------------------------------------------------------ sources and sinks


def _round_trip(name: str, fmt: str, back: Callable[[SparkSession, str], DataFrame], columns: list[str], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = ordered.scratch(spark, "export")
        io.export(table(spark, sf_dir, "orders").select(*columns), path, fmt)
        return rounded(back(spark, path), 4)

    QUERIES[name], ORACLES[name] = query, sql


def _ingested(spark: SparkSession, path: str) -> DataFrame:
    target = ordered.scratch(spark, "ingest")
    io.ingest(spark, path, target)
    return io.read_parquet(spark, target)


_COLUMNS = ["o_orderkey", "o_orderpriority", "o_totalprice"]
_BACK = "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 4) AS o_totalprice FROM orders"
_round_trip("export_parquet", "parquet", io.read_parquet, _COLUMNS, _BACK)
_round_trip("export_csv", "csv", lambda spark, path: spark.read.csv(path, header=True, quote='"', escape='"', schema="o_orderkey long, o_orderpriority string, o_totalprice double"), _COLUMNS, _BACK)


def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = ordered.scratch(spark, "source") + ".csv"
    io.export(table(spark, sf_dir, "orders").select(*_COLUMNS), path, "csv")
    return rounded(_ingested(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("long")), 4)


def ingest_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ingested(spark, f"{sf_dir}/orders.parquet").select(*_COLUMNS), 4)


def ingest_excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = ordered.scratch(spark, "source") + ".xlsx"
    rows = table(spark, sf_dir, "orders").select(*_COLUMNS, "o_orderdate", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("customer"), (F.col("o_totalprice") > 100000).alias("dear"))
    io.export(rows, path, "xlsx")
    return rounded(_ingested(spark, path).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), 4)


QUERIES["ingest_excel"], ORACLES["ingest_excel"] = ingest_excel, """SELECT o_orderkey, o_orderpriority, round(o_totalprice, 4) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
    CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS customer, o_totalprice > 100000 AS dear FROM orders"""
QUERIES["ingest_csv"], ORACLES["ingest_csv"] = ingest_csv, _BACK
QUERIES["ingest_parquet"], ORACLES["ingest_parquet"] = ingest_parquet, _BACK


def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = ordered.scratch(spark, "records")
    io.json_records(table(spark, sf_dir, "orders"), None).write.text(written)
    return rounded(spark.read.schema("o_orderkey long, o_orderpriority string, o_totalprice double").json(written), 4)


QUERIES["json_records"], ORACLES["json_records"] = sample_records, _BACK

# ------------------------------------------------------------------ expressions and filters that no other query has


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


def expression_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.pipeline import run_pipeline

    either = {"op": "or", "args": [{"op": "ilike", "left": {"col": "source"}, "right": {"val": "%A%"}}, {"op": ">", "left": {"col": "n_chars"}, "right": {"val": 2000}}]}
    two = {"op": "func", "name": "log", "args": [{"val": 2}, {"col": "n_chars"}]}
    return rounded(run_pipeline(_labelled(spark, sf_dir), [
        {"op": "filter_rows_safe", "args": {"expr": either}},
        {"op": "add_computed_safe", "args": {"name": "bits", "expr": two}},
        {"op": "select_columns", "args": {"columns": ["doc_id", "bits"]}},
    ]), 6)


QUERIES["expression_more"] = expression_more
ORACLES["expression_more"] = f"SELECT doc_id, round(log(2, n_chars), 6) AS bits FROM {LABELLED} WHERE source ILIKE '%A%' OR n_chars > 2000"


def query_spec_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.query import run_query

    return run_query(_labelled(spark, sf_dir), {"select": ["doc_id", "source"], "filters": [{"col": "quality", "op": "IS", "value": None}, {"col": "lang", "op": "NOT IN", "value": ["de", "fr"]}, {"col": "source", "op": "IS NOT", "value": None}], "limit": 5_000_000})


QUERIES["query_spec_nulls"] = query_spec_nulls
ORACLES["query_spec_nulls"] = f"SELECT doc_id, source FROM {LABELLED} WHERE quality IS NULL AND lang NOT IN ('de', 'fr') AND source IS NOT NULL"
