"""Queries for fitted models, with SQL that solves the same problems in closed form or follows the same steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .concept_queries import SOURCES, _sql_source, add
from .concepts import tukey
from .models import clusters, features, glm, likelihood, linear, quantile, selection, trees
from .queries import ORACLES, QUERIES, rounded, table

SOURCES |= {
    "folded": ("lineitem", ["l_extendedprice / 1000 AS y", "l_quantity AS a", "l_discount * 100 AS b", "l_orderkey % 5 AS fold", "cast(l_returnflag = 'R' as int) AS returned", "cast(l_returnflag = 'N' as int) AS new", "l_partkey % 3 AS third"]),
    "shaped": ("part", ["p_partkey AS k", "array(cast(p_size as double), p_retailprice / 50) AS v"]),
    "points": ("embeddings", ["vec_id", "embedding AS v", "label"]),
}

# ------------------------------------------------------------------ penalised regression

_PENALTIES = [0.0, 0.01, 0.3, 2.0, 9.0, 40.0]


def _net_sql(moments: str, keys: str, penalties: list[float], mixes: list[float], where: str = "") -> str:
    """CTEs up to ``fit``: the two-predictor solution by trying every pattern of signs.

    ``moments`` has ``keys`` and n, my, m1, m2, s1, s2, r (correlation of the predictors), c1, c2 (covariance with y over s).
    """
    grid = ", ".join(f"({m}::DOUBLE, {p}::DOUBLE)" for m in mixes for p in penalties)
    return f"""moments AS ({moments}), grid(mix, penalty) AS (VALUES {grid}), sign(g1, g2) AS (SELECT x, y FROM (VALUES (-1), (0), (1)) p(x), (VALUES (-1), (0), (1)) q(y)),
    tried AS (SELECT *, penalty * mix AS l, 1 + penalty * (1 - mix) AS w FROM moments, grid, sign),
    solved AS (SELECT *,
      CASE WHEN g1 = 0 THEN 0 WHEN g2 = 0 THEN (c1 - l * g1) / w ELSE (w * (c1 - l * g1) - r * (c2 - l * g2)) / (w * w - r * r) END AS b1,
      CASE WHEN g2 = 0 THEN 0 WHEN g1 = 0 THEN (c2 - l * g2) / w ELSE (w * (c2 - l * g2) - r * (c1 - l * g1)) / (w * w - r * r) END AS b2 FROM tried),
    fit AS (SELECT {keys} mix, penalty, b1 / s1 AS k1, b2 / s2 AS k2, my - b1 / s1 * m1 - b2 / s2 * m2 AS k0 FROM solved
      WHERE CASE WHEN g1 = 0 THEN abs(c1 - r * b2) <= l ELSE sign(b1) = g1 END AND CASE WHEN g2 = 0 THEN abs(c2 - r * b1) <= l ELSE sign(b2) = g2 END)"""


_MOMENTS = "count(*) AS n, avg(y) AS my, avg(a) AS m1, avg(b) AS m2, stddev_pop(a) AS s1, stddev_pop(b) AS s2, corr(a, b) AS r, covar_pop(a, y) / stddev_pop(a) AS c1, covar_pop(b, y) / stddev_pop(b) AS c2"


def _path(mix: float):
    def run(df: DataFrame) -> DataFrame:
        rows = [(p["penalty"], p["coefficients"]["const"], p["coefficients"]["a"], p["coefficients"]["b"]) for p in linear.elastic_net(df, "y", ["a", "b"], _PENALTIES, mix)]
        return df.sparkSession.createDataFrame(rows, "penalty double, const double, a double, b double")

    return run


for _slug, _mix in (("elastic_net", 0.5), ("regularization_lasso", 1.0), ("regularization_ridge", 0.0)):
    add(f"concept_{_slug}", "folded", _path(_mix), f"WITH {_net_sql(f'SELECT {_MOMENTS} FROM {_sql_source('folded')}', '', _PENALTIES, [_mix])} SELECT penalty, round(k0, 4) AS const, round(k1, 4) AS a, round(k2, 4) AS b FROM fit")

_GRID, _MIXES = [0.0, 0.5, 3.0], [1.0, 0.4]


def _scores(df: DataFrame) -> DataFrame:
    found = linear.cross_validate(df, "y", ["a", "b"], "fold", 5, _GRID, _MIXES)["scores"]
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in found], "mix double, penalty double, fold int, n long, train_mse double, test_mse double")


_FOLDED = f"""WITH d AS (SELECT * FROM {_sql_source('folded')}), f AS (SELECT DISTINCT fold AS f FROM d),
    {_net_sql(f'SELECT f, {_MOMENTS} FROM f JOIN d ON fold <> f GROUP BY f', 'f,', _GRID, _MIXES)},
    e AS (SELECT mix, penalty, f, fold = f AS held, y - k0 - k1 * a - k2 * b AS e FROM fit, d),
    scores AS (SELECT mix, penalty, f::INT AS fold, count(*) FILTER (held) AS n, avg(e * e) FILTER (NOT held) AS train_mse, avg(e * e) FILTER (held) AS test_mse FROM e GROUP BY ALL)"""
add("concept_cross_validation", "folded", _scores, f"{_FOLDED} SELECT mix, penalty, fold, n, round(train_mse, 4) AS train_mse, round(test_mse, 4) AS test_mse FROM scores")


def _tuned(df: DataFrame) -> DataFrame:
    found = linear.cross_validate(df, "y", ["a", "b"], "fold", 5, _GRID, _MIXES)
    return df.sparkSession.createDataFrame([(r["mix"], r["penalty"], r["mean_mse"], r == found["best"]) for r in found["means"]], "mix double, penalty double, mean_mse double, best boolean")


add("concept_hyperparameter_tuning", "folded", _tuned, f"""{_FOLDED}, m AS (SELECT mix, penalty, sum(n * test_mse) / sum(n) AS mean_mse FROM scores GROUP BY ALL)
    SELECT mix, penalty, round(mean_mse, 4) AS mean_mse, row_number() OVER (ORDER BY round(mean_mse, 9), penalty DESC, mix DESC) = 1 AS best FROM m""")


def _curve(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in linear.learning_curve(df, "y", ["a", "b"], "fold", 5)], "n long, train_mse double, test_mse double")


add("concept_learning_curves", "folded", _curve, f"""WITH d AS (SELECT * FROM {_sql_source('folded')}), f AS (SELECT DISTINCT fold AS f FROM d WHERE fold > 0),
    {_net_sql(f'SELECT f, {_MOMENTS} FROM f JOIN d ON fold BETWEEN 1 AND f GROUP BY f', 'f,', [0.0], [0.0])},
    e AS (SELECT f, fold, y - k0 - k1 * a - k2 * b AS e FROM fit, d WHERE fold <= f)
    SELECT count(*) FILTER (fold > 0) AS n, round(avg(e * e) FILTER (fold > 0), 4) AS train_mse, round(avg(e * e) FILTER (fold = 0), 4) AS test_mse FROM e GROUP BY f""")

# ------------------------------------------------------------------ quantile regression

#: With a column for each group, the fit goes through the groups' own quantiles.
_SHARE = 0.3137
add("concept_quantile_regression", "folded", lambda df: quantile.quantile_regression(df, "y", ["returned", "new"], _SHARE)["coefficients"], f"""WITH
    d AS (SELECT returned * 2 + new AS g, y, row_number() OVER (PARTITION BY returned, new ORDER BY y) AS i, count(*) OVER (PARTITION BY returned, new) AS n FROM {_sql_source('folded')}),
    q AS (SELECT g, y FROM d WHERE i = ceil({_SHARE} * n)), s AS (SELECT (SELECT y FROM q WHERE g = 0) AS c, (SELECT y FROM q WHERE g = 2) AS r, (SELECT y FROM q WHERE g = 1) AS w)
    SELECT 'const' AS measure, round(c, 4) AS value FROM s UNION ALL SELECT 'returned', round(r - c, 4) FROM s UNION ALL SELECT 'new', round(w - c, 4) FROM s""")

# ------------------------------------------------------------------ clusters and components


def concept_k_means_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of Lloyd's steps from the vectors of the five smallest ids; each vector's cluster and squared distance then."""
    rows = table(spark, sf_dir, "embeddings")
    start = [r["embedding"] for r in rows.orderBy("vec_id").limit(5).collect()]
    centres = clusters.k_means(rows, "embedding", 5, rounds=3, start=start, tolerance=-1)["centres"]
    import numpy as np

    return rounded(clusters.assign(rows.select("vec_id", "embedding"), "embedding", np.array(centres), "cluster", "distance").drop("embedding"), 4)


def _round_sql(i: int) -> str:
    return f""", d{i} AS (SELECT vec_id, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p, c{i}),
    a{i} AS (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY vec_id),
    u{i} AS (SELECT c, j, avg(v[j]) AS x FROM p JOIN a{i} USING (vec_id), range(1, 1 + (SELECT max(len(v)) FROM p)) r(j) GROUP BY c, j),
    c{i + 1} AS (SELECT c, list(x ORDER BY j) AS m FROM u{i} GROUP BY c)"""


QUERIES["concept_k_means_clustering"] = concept_k_means_clustering
ORACLES["concept_k_means_clustering"] = " ".join(
    f"""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS c, v AS m FROM p ORDER BY vec_id LIMIT 5)
    {_round_sql(0)}{_round_sql(1)}{_round_sql(2)}{_round_sql(3)} SELECT vec_id, c AS cluster, round(d, 4) AS distance FROM a3""".split()
)


def concept_silhouette_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.silhouette(table(spark, sf_dir, "embeddings"), "embedding", "label").select("vec_id", "silhouette"), 4)


QUERIES["concept_silhouette_score"] = concept_silhouette_score
ORACLES["concept_silhouette_score"] = " ".join("""WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS s FROM embeddings),
    d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(a.s + b.s - 2 * list_inner_product(a.v, b.v)) AS d, count(*) AS n FROM p a, p b GROUP BY ALL),
    m AS (SELECT vec_id, max(n) FILTER (own = other) AS n, max(d / greatest(n - 1, 1)) FILTER (own = other) AS inner_d, min(d / n) FILTER (own <> other) AS outer_d FROM d GROUP BY vec_id)
    SELECT vec_id, round(CASE WHEN n > 1 THEN (outer_d - inner_d) / greatest(outer_d, inner_d) ELSE 0 END, 4) AS silhouette FROM m""".split())


def _components(df: DataFrame) -> dict:
    fit = clusters.principal_components(df, "v", 2)
    return {"variance": fit["variances"], "share": fit["shares"][0], "first": fit["components"][0]}


add("concept_principal_component_analysis", "shaped", _components, f"""WITH s AS (SELECT var_samp(v[1]) AS a, covar_samp(v[1], v[2]) AS b, var_samp(v[2]) AS c FROM (SELECT [p_size::DOUBLE, p_retailprice / 50] AS v FROM part)),
    e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM s),
    u AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS x, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS y FROM e), w AS (SELECT *, CASE WHEN abs(x) > abs(y) THEN sign(x) ELSE sign(y) END AS g FROM u)
    SELECT unnest(['variance.0', 'variance.1', 'share', 'first.0', 'first.1']) AS measure, round(unnest([l1, l2, l1 / (a + c), x * g, y * g]), 4) AS value FROM w""")

# ------------------------------------------------------------------ trees

_X = ["b", "third", "returned"]


def _node_rows(tree: trees.Tree) -> list[tuple]:
    rows, open_ = [], [(0, "top")]
    while open_:
        node, name = open_.pop()
        if tree.feature[node] >= 0:
            rows.append((name, _X[tree.feature[node]], tree.threshold[node], tree.gain[node]))
            open_ += [(tree.left[node], f"{name}.left"), (tree.right[node], f"{name}.right")]
    return rows


def _tree(df: DataFrame) -> DataFrame:
    tree = trees.decision_tree(df, "y", _X, depth=2).trees[0]
    return df.sparkSession.createDataFrame(_node_rows(tree), "node string, feature string, threshold double, gain double").withColumn("gain", F.round("gain", 1))


def _best_split(name: str, rows: str) -> str:
    """CTEs: the best split of ``rows`` (with y and the columns), by all their values."""
    sides = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS place, {c}::DOUBLE AS v, y FROM {rows}" for i, c in enumerate(_X))
    return f"""{name}_v AS (SELECT feature, place, v, sum(y) AS s, count(*) AS n FROM ({sides}) GROUP BY ALL),
    {name}_c AS (SELECT *, sum(s) OVER w AS sl, sum(n) OVER w AS nl, sum(s) OVER (PARTITION BY feature) AS st, sum(n) OVER (PARTITION BY feature) AS nt FROM {name}_v WINDOW w AS (PARTITION BY feature ORDER BY v)),
    {name} AS (SELECT feature, v AS threshold, sl * sl / nl + (st - sl) ** 2 / (nt - nl) - st * st / nt AS gain, sl / nl AS ml, (st - sl) / (nt - nl) AS mr FROM {name}_c
      WHERE nt - nl >= 20 AND nl >= 20 ORDER BY round(gain, 6) DESC, place, v LIMIT 1)"""


def _goes_left(split: str) -> str:
    return "CASE " + " ".join(f"WHEN {split}.feature = '{c}' THEN d.{c}" for c in _X) + f" END <= {split}.threshold"


add("concept_decision_trees", "folded", _tree, f"""WITH d AS (SELECT y, b, third, returned FROM {_sql_source('folded')}), {_best_split('t', 'd')},
    l_d AS (SELECT d.* FROM d, t WHERE {_goes_left('t')}), r_d AS (SELECT d.* FROM d, t WHERE NOT ({_goes_left('t')})), {_best_split('l', 'l_d')}, {_best_split('r', 'r_d')}
    SELECT 'top' AS node, feature, threshold, round(gain, 1) AS gain FROM t UNION ALL SELECT 'top.left', feature, threshold, round(gain, 1) FROM l UNION ALL SELECT 'top.right', feature, threshold, round(gain, 1) FROM r""", 9)


def _boosted(df: DataFrame) -> DataFrame:
    model = trees.gradient_boosting(df, "y", _X, trees=2, depth=1, step=0.5)
    return trees.predicted(df.select(*_X).distinct(), model)


add("concept_gradient_boosting", "folded", _boosted, f"""WITH d0 AS (SELECT y AS y0, b, third, returned FROM {_sql_source('folded')}), base AS (SELECT avg(y0) AS m FROM d0),
    e AS (SELECT y0 - m AS y, b, third, returned FROM d0, base), {_best_split('t', 'e')},
    d AS (SELECT * FROM e), e2 AS (SELECT y - 0.5 * CASE WHEN {_goes_left('t')} THEN ml ELSE mr END AS y, b, third, returned FROM d, t), {_best_split('u', 'e2')}
    SELECT DISTINCT b, third, returned, round(m + 0.5 * CASE WHEN {_goes_left('t')} THEN t.ml ELSE t.mr END + 0.5 * CASE WHEN {_goes_left('u')} THEN u.ml ELSE u.mr END, 4) AS prediction FROM d, base, t, u""")

# ------------------------------------------------------------------ feature selection


def concept_feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("month", F.month("l_shipdate"))
    return rounded(selection.feature_scores(rows, "l_returnflag", ["l_linestatus", "l_linenumber", "month", "l_tax"]).drop("p_value"), 6)


def _scores_sql(name: str, column: str) -> str:
    return f"""SELECT '{name}' AS "column", max(total)::BIGINT AS n, max(levels) AS levels, sum((n - e) ** 2 / e) AS chi_square, max((levels - 1) * (outcomes - 1)) AS dof,
    sqrt(sum((n - e) ** 2 / e) / (max(total) * (max(least(levels, outcomes)) - 1))) AS cramers_v, sum(CASE WHEN n > 0 THEN n / total * ln(n / e) ELSE 0 END) AS mutual_information
    FROM (SELECT coalesce(c.n, 0) AS n, v.n * t.n / total AS e, total, levels, outcomes FROM (SELECT {column} AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) v CROSS JOIN
    (SELECT l_returnflag AS t, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) t CROSS JOIN (SELECT count(*)::DOUBLE AS total, count(DISTINCT {column}) AS levels, count(DISTINCT l_returnflag) AS outcomes FROM lineitem) s
    LEFT JOIN (SELECT {column} AS v, l_returnflag AS t, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2) c ON c.v = v.v AND c.t = t.t)"""


QUERIES["concept_feature_selection"] = concept_feature_selection
_ALL_SCORES = " UNION ALL ".join(_scores_sql(n, c) for n, c in (("l_linestatus", "l_linestatus"), ("l_linenumber", "l_linenumber"), ("month", "month(l_shipdate)"), ("l_tax", "l_tax")))
ORACLES["concept_feature_selection"] = " ".join(f'SELECT "column", n, levels, round(chi_square, 6) AS chi_square, dof, round(cramers_v, 6) AS cramers_v, round(mutual_information, 6) AS mutual_information FROM ({_ALL_SCORES})'.split())

# ------------------------------------------------------------------ maximum likelihood

_DIGAMMA = "(ln(k + 10) - 0.5 / (k + 10) - 1 / (12 * (k + 10) ** 2) + 1 / (120 * (k + 10) ** 4) - 1 / (252 * (k + 10) ** 6) - (" + " + ".join(f"1 / (k + {i})" for i in range(10)) + "))"


def _fitted(family: str, name: str, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(likelihood.fit(table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_extendedprice") / 1000), "x", family, ["l_suppkey"]), 3)

    QUERIES[name], ORACLES[name] = query, " ".join(sql.split())


_fitted("gamma", "concept_maximum_likelihood_gamma", f"""WITH RECURSIVE g AS (SELECT l_suppkey, count(*) AS n, avg(x) AS m, avg(ln(x)) AS l FROM (SELECT l_suppkey, l_extendedprice / 1000 AS x FROM lineitem) GROUP BY 1),
    s AS (SELECT *, 1e-3 AS lo, 1e3 AS hi, 0 AS i, sqrt(1e-3 * 1e3) AS k FROM g
      UNION ALL SELECT l_suppkey, n, m, l, CASE WHEN up THEN k ELSE lo END, CASE WHEN up THEN hi ELSE k END, i + 1, CASE WHEN up THEN sqrt(k * hi) ELSE sqrt(lo * k) END
      FROM (SELECT *, ln(k) - {_DIGAMMA} > ln(m) - l AS up FROM s) WHERE i < 60)
    SELECT l_suppkey, n, round(k, 3) AS shape, round(k / m, 3) AS rate, round(n * (k * ln(k / m) - lgamma(k) + (k - 1) * l - k), 3) AS log_likelihood FROM s WHERE i = 60""")


def _weibull_step(i: int) -> str:
    return f""", k{i + 1} AS (SELECT l_suppkey, any_value(k) - (any_value(f) / any_value(h)) AS k FROM (SELECT l_suppkey, any_value(k) AS k, sum(p * u) / sum(p) - 1 / any_value(k) - avg(u) AS f, sum(p * u * u) / sum(p) - (sum(p * u) / sum(p)) ** 2 + 1 / any_value(k) ** 2 AS h
    FROM (SELECT d.l_suppkey, k, u, exp(k * u) AS p FROM d JOIN k{i} USING (l_suppkey)) GROUP BY 1) GROUP BY 1)"""


_fitted("weibull", "concept_maximum_likelihood_weibull", f"""WITH d AS (SELECT l_suppkey, ln(l_extendedprice / 1000) AS l, ln(l_extendedprice / 1000) - max(ln(l_extendedprice / 1000)) OVER (PARTITION BY l_suppkey) AS u, max(ln(l_extendedprice / 1000)) OVER (PARTITION BY l_suppkey) AS top FROM lineitem),
    k0 AS (SELECT l_suppkey, pi() / sqrt(6) / stddev_pop(l) AS k FROM d GROUP BY 1) {''.join(_weibull_step(i) for i in range(9))},
    w AS (SELECT l_suppkey, count(*) AS n, any_value(k) AS k, any_value(top) + ln(avg(exp(k * u))) / any_value(k) AS s, avg(l) AS m FROM d JOIN k9 USING (l_suppkey) GROUP BY 1)
    SELECT l_suppkey, n, round(k, 3) AS shape, round(exp(s), 3) AS scale, round(n * (ln(k) - k * s + (k - 1) * m - 1), 3) AS log_likelihood FROM w""")
_fitted("lognormal", "concept_maximum_likelihood_lognormal", """SELECT l_suppkey, count(*) AS n, round(avg(l), 3) AS log_mean, round(stddev_pop(l), 3) AS log_std,
    round(-count(*) * (ln(stddev_pop(l)) + 0.5 * ln(2 * pi()) + 0.5) - sum(l), 3) AS log_likelihood FROM (SELECT l_suppkey, ln(l_extendedprice / 1000) AS l FROM lineitem) GROUP BY 1""")

# ------------------------------------------------------------------ all pairs of groups

QUERIES["concept_tukey"] = lambda spark, sf_dir: rounded(tukey(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linenumber").drop("p_value"), 4)
ORACLES["concept_tukey"] = " ".join("""WITH g AS (SELECT l_linenumber AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1),
    e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g)
    SELECT a.g AS a, b.g AS b, round(a.m - b.m, 4) AS difference, round(abs(a.m - b.m) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 4) AS q_statistic FROM g a JOIN g b ON a.g < b.g, e""".split())

# ------------------------------------------------------------------ generalized linear models and engineered features

_GROUP_MEANS = f"(SELECT returned * 2 + new AS g, avg(y) AS m, count(*) AS n FROM {_sql_source('folded')} GROUP BY 1)"


def _glm(family: str, deviance: str, dispersion: str, weight: str) -> None:
    """With a column for each group, the fitted means are the groups'; ``weight`` is that of a row in the errors."""

    def run(df: DataFrame) -> dict:
        r = glm.generalized_linear_model(df, "y", ["returned", "new"], family)
        return {"deviance": r["deviance"], "dispersion": r["dispersion"], "const": r["coefficients"]["const"], "returned": r["coefficients"]["returned"], "new": r["coefficients"]["new"], "error": r["std_errors"]["const"]}

    at = lambda g: f"(SELECT ln(m) FROM g WHERE g = {g})"
    add(f"concept_generalized_linear_models_{family}", "folded", run, f"""WITH g AS {_GROUP_MEANS}, d AS (SELECT y, m FROM {_sql_source('folded')} JOIN g ON g = returned * 2 + new),
        s AS (SELECT sum({deviance}) AS deviance, {dispersion} AS dispersion FROM d), w AS (SELECT sqrt(dispersion / (n * {weight})) AS e FROM g, s WHERE g = 0)
        SELECT unnest(['deviance', 'dispersion', 'const', 'returned', 'new', 'error']) AS measure, round(unnest([deviance, dispersion, {at(0)}, {at(2)} - {at(0)}, {at(1)} - {at(0)}, e]), 4) AS value FROM s, w""")


_glm("poisson", "2 * (y * ln(y / m) - (y - m))", "1.0", "m")
_glm("gamma", "2 * ((y - m) / m - ln(y / m))", "sum((y - m) ** 2 / (m * m)) / (count(*) - 3)", "1")


def concept_feature_engineering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    return rounded(features.engineered(rows, ["o_totalprice", "o_orderdate", "o_orderpriority"], 9).drop("o_totalprice", "o_orderdate", "o_orderpriority"), 6)


QUERIES["concept_feature_engineering"] = concept_feature_engineering
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ORACLES["concept_feature_engineering"] = """SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice_z, round(ln(1 + o_totalprice), 6) AS o_totalprice_log, 0 AS o_totalprice_missing,
    year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month, isodow(o_orderdate)::INT AS o_orderdate_weekday, hour(o_orderdate)::INT AS o_orderdate_hour, 0 AS o_orderdate_missing,
    length(o_orderpriority)::INT AS o_orderpriority_length, 0 AS o_orderpriority_missing, """ + ", ".join(
    f"(o_orderpriority = '{v}')::INT AS o_orderpriority_is_{v.replace('-', '_').replace(' ', '_')}" for v in _PRIORITIES
) + " FROM orders"
