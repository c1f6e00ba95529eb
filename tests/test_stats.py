"""Analyses against values worked out by hand or by plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import concepts
from sparkloom.stats import ANALYSES, analyse, result
from sparkloom.stats import distributions as D
from sparkloom.stats import ranks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_tails():
    # well-known quantiles
    assert D.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert D.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert D.chi2_sf(18.307038053, 10) == pytest.approx(0.05, abs=1e-8)
    assert D.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert D.normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert D.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert D.t_quantile(0.05, 10) == pytest.approx(2.228138852, abs=1e-6)
    # a t of one degree of freedom is a Cauchy variable
    assert D.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)


def test_t_tests(spark):
    df = frame(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 3.0), (4.0, 7.0), (None, 1.0)], "a double, b double")
    one = result(df, "ttest_1samp", {"column": "a", "popmean": 2})
    assert one["n"] == 4 and one["t_statistic"] == pytest.approx(0.5 / (math.sqrt(5 / 3) / 2))
    two = result(df, "ttest", {"column1": "a", "column2": "b"})
    assert two["t_statistic"] == pytest.approx((2.5 - 4) / math.sqrt((5 / 3) / 4 + (14 / 3) / 4))
    paired = result(df, "paired_ttest", {"before": "a", "after": "b"})
    assert paired["mean_difference"] == 1.5 and paired["t_statistic"] == pytest.approx(-1.5 / (math.sqrt(5 / 3) / 2))


def test_anova_and_kruskal(spark):
    df = frame(spark, [(x, g) for g, xs in {"a": [1, 2, 3], "b": [2, 3, 4], "c": [5, 6, 7]}.items() for x in xs] + [(None, "a"), (1, None)], "v int, g string")
    a = result(df, "anova", {"value": "v", "group": "g"})
    assert a["f_statistic"] == pytest.approx(13.0) and (a["df_between"], a["df_within"]) == (2, 6) and a["p_value"] == pytest.approx((1 + 13 / 3) ** -3)
    k = result(df, "kruskal_wallis", {"value": "v", "group": "g"})
    r = {"a": [1, 2.5, 4.5], "b": [2.5, 4.5, 6], "c": [7, 8, 9]}
    h = 12 / 90 * sum(sum(x) ** 2 / 3 for x in r.values()) - 30
    assert k["h_statistic"] == pytest.approx(h / (1 - 12 / 720))
    with pytest.raises(ValueError):
        result(df.filter("g = 'a'"), "anova", {"value": "v", "group": "g"})


def test_chi_square(spark):
    table = frame(spark, [(x, y) for x, y, n in (("a", "u", 10), ("a", "v", 20), ("b", "u", 30), ("b", "v", 5)) for _ in range(n)], "x string, y string")
    got = result(table, "chi-square-test", {"column1": "x", "column2": "y"})
    o, n = np.array([[10, 20], [30, 5]]), 65
    e = o.sum(1, keepdims=True) * o.sum(0) / n
    assert got["chi2_statistic"] == pytest.approx((((abs(o - e) - 0.5) ** 2) / e).sum()) and got["df"] == 1
    good = result(frame(spark, [(8,), (12,), (10,)], "o int"), "chi_square_goodness", {"observed": "o"})
    assert good["chi2_statistic"] == pytest.approx(0.8) and good["p_value"] == pytest.approx(math.exp(-0.4))


def test_rank_tests(spark):
    df = frame(spark, [(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)], "a double, b double")
    u = result(df, "mann_whitney", {"column1": "a", "column2": "b"})
    assert u["u_statistic"] == 0 and u["p_value"] == pytest.approx(0.1)  # 2 of the 20 arrangements
    df = frame(spark, [(float(i), float(i) + (1 + i / 10)) for i in range(6)] + [(1.0, 1.0)], "a double, b double")
    w = result(df, "wilcoxon_signed_rank", {"before": "a", "after": "b"})
    assert w["w_statistic"] == 0 and w["n"] == 6 and w["p_value"] == pytest.approx(2 / 64)


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_kendall_counts_all_pairs(spark, monkeypatch, block):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, 90), rng.integers(0, 12, 90)
    pairs = frame(spark, [(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    swaps = sum((x[i] - x[j]) * (y[i] - y[j]) < 0 for i in range(90) for j in range(i))
    assert ranks.discordant_pairs(pairs, block) == swaps
    same = sum((x[i] - x[j]) * (y[i] - y[j]) > 0 for i in range(90) for j in range(i))
    ties = lambda v: sum(v[i] == v[j] for i in range(90) for j in range(i))
    total = 90 * 89 / 2
    got = result(pairs, "correlation", {"x": "x", "y": "y", "method": "kendall"})
    assert got["correlation"] == pytest.approx((same - swaps) / math.sqrt((total - ties(x)) * (total - ties(y))))


def test_correlations(spark):
    df = frame(spark, [(1.0, 1.0), (2.0, 8.0), (3.0, 27.0), (4.0, 64.0), (5.0, None)], "x double, y double")
    assert result(df, "spearman-correlation", {"x": "x", "y": "y"})["correlation"] == pytest.approx(1.0)
    r = result(df, "correlation", {"x": "x", "y": "y"})
    assert r["n"] == 4 and r["correlation"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [1, 8, 27, 64])[0, 1])
    m = result(df, "correlation_matrix", {"columns": ["x", "y"]})
    assert m["n"] == 4 and m["matrix"]["y"]["x"] == pytest.approx(r["correlation"])
    with pytest.raises(ValueError):
        result(df.limit(2), "correlation", {"x": "x", "y": "y"})


def test_regression(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=60), rng.normal(size=60) + 1e4
    y = 3 + 2 * x1 - 0.5 * x2 + rng.normal(size=60)
    df = frame(spark, [(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)] + [(None, 1.0, 1.0)], "x1 double, x2 double, y double")
    got = result(df, "regression", {"y": "y", "x": ["x1", "x2"]})
    design = np.column_stack([np.ones(60), x1, x2])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rest = y - design @ beta
    se = np.sqrt(rest @ rest / 57 * np.diag(np.linalg.inv(design.T @ design)))
    assert list(got["coefficients"].values()) == pytest.approx(beta.tolist(), rel=1e-6)
    assert list(got["std_errors"].values())[1:] == pytest.approx(se.tolist()[1:], rel=1e-5)
    assert got["r_squared"] == pytest.approx(1 - rest @ rest / ((y - y.mean()) ** 2).sum())


def test_logistic_regression(spark):
    # with one two-valued predictor, the coefficients are log odds
    rows = [(0.0, 1)] * 10 + [(0.0, 0)] * 30 + [(1.0, 1)] * 24 + [(1.0, 0)] * 8
    got = result(frame(spark, rows, "x double, y int"), "logistic_regression", {"y": "y", "x": "x"})
    assert got["coefficients"]["const"] == pytest.approx(math.log(10 / 30)) and got["coefficients"]["x"] == pytest.approx(math.log(9))
    assert got["std_errors"]["x"] == pytest.approx(math.sqrt(1 / 10 + 1 / 30 + 1 / 24 + 1 / 8), rel=1e-6)
    with pytest.raises(ValueError):
        result(frame(spark, [(float(i), 1) for i in range(30)], "x double, y int"), "logistic_regression", {"y": "y", "x": "x"})


def test_normality(spark):
    # weights and heights of a published worked example of the W test: n = 11
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    got = result(frame(spark, [(float(v),) for v in men], "v double"), "normality_test", {"column": "v"})
    assert got["shapiro_statistic"] == pytest.approx(0.79, abs=0.01) and got["shapiro_p_value"] < 0.02
    z = sorted((v - np.mean(men)) / np.std(men, ddof=1) for v in men)
    cdf = np.array([D.normal_cdf(t) for t in z])
    i = np.arange(1, 12)
    assert got["anderson_statistic"] == pytest.approx(-11 - ((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1]))).mean())
    assert got["ks_statistic"] == pytest.approx(max((i / 11 - cdf).max(), (cdf - (i - 1) / 11).max()))
    rng = np.random.default_rng(3)
    normal = result(frame(spark, [(float(v),) for v in rng.normal(size=400)], "v double"), "normality_test", {"column": "v"})
    assert normal["shapiro_p_value"] > 0.01 and normal["shapiro_statistic"] > 0.99


def test_series_and_outliers(spark):
    df = frame(spark, [(3, 3.0), (1, 1.0), (2, 2.0), (4, 100.0)], "t int, v double")
    got = result(df, "moving_average", {"column": "v", "window": 2, "order_by": "t"}).orderBy("i").collect()
    assert [r.moving_average for r in got] == [None, 1.5, 2.5, 51.5]
    assert result(df, "trend_analysis", {"column": "v", "time_col": "t"})["slope"] == pytest.approx(29.8)
    assert [r.v for r in result(df, "outlier_detection", {"column": "v", "method": "modified_z"}).collect()] == [100.0]
    with pytest.raises(ValueError):
        result(df, "outlier_detection", {"column": "v", "method": "nonsense"})


def test_dispatch(spark):
    df = frame(spark, [(1.0,), (2.0,), (None,)], "v double")
    assert {r.measure: r.value for r in analyse(df, "descriptives", {"columns": ["v"]}).collect()}["v.rows_missing"] == 1
    with pytest.raises(ValueError):
        analyse(df, "nonsense")
    assert result(df, "mean", {"columns": "v"}, "print") is result(df, "mean", {"columns": "v"}, "print")
    assert len(set(ANALYSES.values())) >= 19


def test_every_group_of_many_is_kept(spark):
    df = spark.range(3600).selectExpr("id % 1200 as g", "cast(id % 1200 + id div 1200 as double) as v")
    a = result(df, "anova", {"value": "v", "group": "g"})
    groups = {r.group: (r["mean"], r.std, r.n) for r in a["groups"].collect()}
    assert groups == {i: (i + 1.0, 1.0, 3) for i in range(1200)}
    assert analyse(df, "anova", {"value": "v", "group": "g"}).filter("measure = 'groups.1150.mean'").first().value == 1151.0
    run = concepts.CONCEPTS["post-hoc-tests"].run
    # Welch's t of samples of three with variance 1: the difference over the square root of 2/3, with 4 degrees of freedom
    one = run(df, "v", "g", pairs=[(3, 1150)]).collect()
    assert [(r.a, r.b) for r in one] == [(3, 1150)] and one[0].t_statistic == pytest.approx(-1147 / math.sqrt(2 / 3))
    some = {(r.a, r.b): r.p_value for r in run(df, "v", "g", groups=[1100, 1101, 1199]).collect()}
    assert set(some) == {(1100, 1101), (1100, 1199), (1101, 1199)}
    alone = run(df, "v", "g", pairs=[(1100, 1101)]).first().p_value
    assert some[1100, 1101] == pytest.approx(min(1.0, 3 * alone)) and 0 < alone < 1
    assert run(df, "v", "g").count() == 1200 * 1199 // 2


def test_concepts(spark):
    assert len(concepts.CONCEPTS) == 108 and concepts.search("kendall")
    df = frame(spark, [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.2), (0, 1, 0.6), (1, 1, 0.8)], "y int, p int, q double")
    run = lambda slug, *a, **k: concepts.CONCEPTS[slug].run(*a, **k)
    assert run("precision", df, "y", "p") == pytest.approx(2 / 3) == run("recall", df, "y", "p")
    assert run("specificity", df, "y", "p") == 0.5 and run("accuracy", df, "y", "p") == 0.6
    assert run("brier-score", df, "y", "q") == pytest.approx((0.01 + 0.36 + 0.04 + 0.36 + 0.04) / 5)
    series = frame(spark, [(i, float(i % 4) + i) for i in range(24)], "t int, v double")
    parts = run("decomposition", series, "v", "t", 4).filter("trend is not null").collect()
    assert max(abs(r.remainder) for r in parts) < 1e-9
    a = run("acf", series, "v", "t", 3)
    v = np.array([i % 4 + i for i in range(24)], float)
    d = v - v.mean()
    assert a == pytest.approx([float((d[k:] * d[: 24 - k]).sum() / (d * d).sum()) for k in range(4)])
    assert run("pacf", series, "v", "t", 2)[:2] == pytest.approx([1.0, a[1]])
    ps = frame(spark, [(0.01,), (0.04,), (0.03,), (0.5,)], "p double")
    assert sorted(r.p_adjusted for r in run("fdr", ps, "p").collect()) == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])
    smooth = run("exponential-smoothing", frame(spark, [("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 5.0)], "g string, t int, v double"), "v", "t", ["g"], 0.5)
    assert [r.smoothed for r in smooth.orderBy("t").collect()] == [1.0, 2.0, 3.5]
    b = run("bootstrapping", series, "v", 100)
    assert b["low"] < float(v.mean()) < b["high"]
    assert run("fishers-exact-test", frame(spark, [(True, True)] * 3 + [(False, False)] * 3, "a boolean, b boolean"), "a", "b")["p_value"] == pytest.approx(0.1)


def test_values_on_a_histograms_edges_have_the_bins_of_its_sql(spark):
    import duckdb

    sql = "SELECT least(20, floor((v - lo) / (hi - lo) * 20) + 1)::BIGINT AS bin, count(*) FROM (SELECT unnest(range({n} + 1)) / 100 AS v, 0::DOUBLE AS lo, {n} / 100 AS hi) GROUP BY 1"
    for n in (5, 123, 980):
        df = spark.range(n + 1).select((F.col("id") / 100).alias("v")).union(spark.createDataFrame([(None,)], "v double"))
        assert {(r["bin"], r["count"]) for r in concepts.histogram(df, "v").collect()} == set(duckdb.sql(sql.format(n=n)).fetchall())
    same = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert [tuple(r) for r in concepts.histogram(same, "v").collect()] == [(20, 2.0, 2)]
    assert concepts.histogram(same.limit(0), "v").collect() == []
