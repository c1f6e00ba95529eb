"""Models against numpy on the same rows, conditions of optimality, and brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.models import clusters, likelihood, linear, quantile, selection, trees


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) * rng.uniform(0.1, 9, 12) + rng.normal(size=12) * 5
    x[:, 3] = x[:, 2] + rng.normal(size=400) * 0.01
    x[:, 7] = 4.0
    y = x[:, 0] * 2 - x[:, 2] + rng.normal(size=400) + 100
    names = [f"x{i}" for i in range(12)]
    rows = [(*map(float, r), float(v), i % 4) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", y double, fold int").repartition(3)
    odd = spark.createDataFrame([(*[None] * 12, 1.0, 0), (*[float("nan")] * 12, 1.0, 1)], df.schema)
    return df.union(odd).cache(), names, x, y


@pytest.mark.parametrize("mix", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("standardize", [True, False])
def test_penalised_fits_are_optimal(wide, mix, standardize):
    df, names, x, y = wide
    path = linear.elastic_net(df, "y", names, [0.0, 0.05, 1.0, 7.0] if mix else [0.05, 1.0, 7.0], mix, standardize)
    scale = np.where(x.std(0) > 1e-9, x.std(0), 1) if standardize else np.ones(12)
    for p in path:
        b = np.array([p["coefficients"][n] for n in names])
        e = y - p["coefficients"]["const"] - x @ b
        assert abs(e.mean()) < 1e-7 and abs(p["mse"] - (e @ e) / 400) < 1e-6 * p["mse"]
        slope = ((x - x.mean(0)) / scale).T @ e / 400 - p["penalty"] * (1 - mix) * b * scale
        on = b != 0
        assert np.allclose(slope[on], p["penalty"] * mix * np.sign(b[on]), atol=2e-6)
        assert (np.abs(slope[~on]) <= p["penalty"] * mix + 2e-6).all() and p["nonzero"] == on.sum()
    if mix:
        assert linear.elastic_net(df, "y", names, mix=mix)[0]["nonzero"] == 0


def test_cross_validation_equals_fits_fold_by_fold(wide):
    df, names, x, y = wide
    grid, mixes = [0.02, 0.5], [1.0, 0.0]
    got = linear.cross_validate(df, "y", names, "fold", 6, grid, mixes)  # two folds have no rows
    fold = np.arange(400) % 4
    assert len(got["scores"]) == 4 * 2 * 2
    for s in got["scores"]:
        part = df.filter(F.col("fold") != s["fold"])
        own = linear.elastic_net(part, "y", names, [s["penalty"]], s["mix"])[0]["coefficients"]
        e = y - own["const"] - x @ np.array([own[n] for n in names])
        assert s["test_mse"] == pytest.approx((e[fold == s["fold"]] ** 2).mean(), rel=1e-6)
        assert s["train_mse"] == pytest.approx((e[fold != s["fold"]] ** 2).mean(), rel=1e-6)
    for m in got["means"]:
        own = [s["test_mse"] for s in got["scores"] if (s["mix"], s["penalty"]) == (m["mix"], m["penalty"])]
        assert m["mean_mse"] == pytest.approx(np.mean(own)) and m["std_error"] == pytest.approx(np.std(own) / np.sqrt(3))
    assert got["best"] == min(got["means"], key=lambda m: m["mean_mse"]) and got["frugal"] >= got["best"]["penalty"]
    with pytest.raises(ValueError):
        linear.cross_validate(df.filter("fold = 1"), "y", names, "fold", 6)


def test_learning_curve_grows(wide):
    df, names, x, y = wide
    got = linear.learning_curve(df, "y", names, "fold", 4)
    assert [r["n"] for r in got] == [100, 200, 300]
    keep = np.array([n for n in range(12) if n != 7])
    fold = np.arange(400) % 4
    for last, r in enumerate(got, 1):
        train = (fold >= 1) & (fold <= last)
        z = np.column_stack([np.ones(400), x[:, keep]])
        b = np.linalg.lstsq(z[train], y[train], rcond=None)[0]
        assert r["test_mse"] == pytest.approx(((y - z @ b)[fold == 0] ** 2).mean(), rel=1e-5)
    assert linear.learning_curve(df.filter("fold = 0"), "y", names, "fold", 4) == []


@pytest.mark.parametrize("share,whole,undecided", [(0.1, False, 40), (0.5, True, 30), (0.83, True, 10_000)])
def test_quantile_regression_is_the_exact_minimum(spark, share, whole, undecided):
    rng = np.random.default_rng(0)
    x = rng.normal(size=50)
    y = 2 * x + rng.normal(size=50) * (1 + np.abs(x))
    if whole:  # ties and many rows on one line
        x, y = np.round(x * 2), np.round(y)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double").coalesce(2)
    loss = lambda b: np.where((r := y - b[0] - b[1] * x) >= 0, share * r, (share - 1) * r).mean()
    best = min(loss(np.linalg.solve([[1, x[i]], [1, x[j]]], [y[i], y[j]])) for i, j in itertools.combinations(range(50), 2) if x[i] != x[j])
    got = quantile.quantile_regression(df, "y", ["x"], share, undecided)
    assert got["loss"] == pytest.approx(best, abs=1e-9) and loss([got["coefficients"]["const"], got["coefficients"]["x"]]) == pytest.approx(best, abs=1e-9)
    # the pulls of the rows off the line are made up for by those on it
    assert got["n"] == 50 == got["below"] + got["on"] + got["above"]
    assert got["below"] <= share * 50 + 1e-9 and got["above"] <= (1 - share) * 50 + 1e-9


def test_clusters_stand_still_and_cost_no_more_than_plain_seeding(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 4)) * 10
    x = np.concatenate([c + rng.normal(size=(60, 4)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id int, v array<double>").repartition(3)
    got = clusters.k_means(df, "v", 6)
    found = np.array(got["centres"])
    near = clusters.distances(x, found).argmin(1)
    assert np.allclose(found, [x[near == j].mean(0) for j in range(6)], atol=1e-7)
    assert got["sizes"] == np.bincount(near, minlength=6).tolist() and sum(got["sizes"]) == 360
    assert got["cost"] == pytest.approx(clusters.distances(x, found).min(1).sum())
    assert got["cost"] <= 1.05 * sum(((x[i * 60 : i * 60 + 60] - x[i * 60 : i * 60 + 60].mean(0)) ** 2).sum() for i in range(6))
    own = clusters.assign(df, "v", found, "c", "d").orderBy("id").collect()
    assert own[0].c is None and own[0].d is None and [r.c for r in own[1:]] == near.tolist()
    two = spark.createDataFrame([([1.0, 1.0],), ([1.0, 1.0],), ([2.0, 2.0],)], "v array<double>")
    assert clusters.k_means(two, "v", 5)["cost"] == 0
    with pytest.raises(ValueError):
        clusters.k_means(df.filter("v is null"), "v", 2)
    with pytest.raises(ValueError):
        clusters.k_means(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v", 2)


def test_silhouette_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(80, 3)), ["a"] * 40 + ["b"] * 39 + ["c"]
    x[:40] += 2
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, c))] + [(90, None, "a"), (91, [1.0, 2.0, 3.0], None)]
    got = {r.id: r.silhouette for r in clusters.silhouette(spark.createDataFrame(rows, "id int, v array<double>, c string"), "v", "c").collect()}
    d = clusters.distances(x, x)
    c = np.array(c)
    for i in range(80):
        inner = d[i, c == c[i]].sum() / max((c == c[i]).sum() - 1, 1)
        outer = min(d[i, c == k].mean() for k in "abc" if k != c[i])
        assert got[i] == pytest.approx((outer - inner) / max(outer, inner) if i < 79 else 0.0, abs=1e-9)
    assert got[90] is None and got[91] is None
    one = spark.createDataFrame([([1.0], "a")], "v array<double>, c string")
    assert clusters.silhouette(one, "v", "c").first().silhouette is None


def test_components_of_short_and_long_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 30)) * np.linspace(5, 0.1, 30) @ np.linalg.qr(rng.normal(size=(30, 30)))[0] + 7
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(3)
    values, basis = np.linalg.eigh(np.cov(x.T))
    for whole in (None, 10):
        got = clusters.principal_components(df, "v", 3, whole=whole)
        assert np.allclose(got["variances"], values[::-1][:3], rtol=1e-8) and max(got["residuals"]) < 1e-6
        assert np.allclose(np.abs(np.array(got["components"]) @ basis[:, ::-1][:, :3]), np.eye(3), atol=1e-5)
        assert np.allclose(got["shares"], values[::-1][:3] / values.sum(), rtol=1e-8)
        scores = np.array([r.scores for r in clusters.projected(df, "v", got).filter("v is not null").collect()])
        assert np.allclose(sorted(scores.var(axis=0, ddof=1)), sorted(got["variances"]), rtol=1e-6)


# ------------------------------------------------------------------ trees


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(9)
    n = 600
    a, b, c = rng.integers(0, 8, n).astype(float), rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    y = np.where(a > 4, 3.0, 0.0) + np.where((b > 0.3) & (c > 0), 2.0, 0.0) + rng.normal(size=n) * 0.2
    rows = [(i, float(p), float(q), float(r), float(s), float(s > 2.5)) for i, (p, q, r, s) in enumerate(zip(a, b, c, y))]
    df = spark.createDataFrame(rows + [(-1, None, 1.0, 1.0, 1.0, 0.0), (-2, float("nan"), 1.0, 1.0, 1.0, 0.0)], "id long, a double, b double, c double, y double, z double").repartition(3)
    return df.cache(), np.column_stack([a, b, c]), y


def plain_tree(x, y, edges, depth, least, rows):
    """Greedy splits by loops; {path: (feature, threshold)} and the leaves' means."""
    best, gain = None, 1e-9
    if depth:
        for j, e in enumerate(edges):
            for t in e:
                left, right = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                if len(left) >= least and len(right) >= least:
                    g = y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - y[rows].sum() ** 2 / len(rows)
                    if g > gain + 1e-9:
                        best, gain = (j, t, left, right), g
    if best is None:
        return {(): y[rows].mean()}
    j, t, left, right = best
    out = {(): (j, t)}
    for side, own in (("l", left), ("r", right)):
        out |= {(side, *k): v for k, v in plain_tree(x, y, edges, depth - 1, least, own).items()}
    return out


def as_paths(tree, node=0):
    if tree.feature[node] < 0:
        return {(): tree.value[node]}
    out = {(): (tree.feature[node], tree.threshold[node])}
    for side, child in (("l", tree.left[node]), ("r", tree.right[node])):
        out |= {(side, *k): v for k, v in as_paths(tree, child).items()}
    return out


def test_a_tree_equals_plain_greedy_splits(mixed):
    df, x, y = mixed
    model = trees.decision_tree(df, "y", ["a", "b", "c"], depth=3, least=15, bins=16)
    edges = trees.cut_points(df.filter("a is not null and not isnan(a)"), ["a", "b", "c"], 16)
    assert [len(e) for e in edges] == [7, 15, 1]
    want, got = plain_tree(x, y, edges, 3, 15, np.arange(600)), as_paths(model.trees[0])
    assert want.keys() == got.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert model.importance()["a"] > model.importance()["b"] > 0 and sum(model.importance().values()) == pytest.approx(1)
    own = {r.id: r.p for r in trees.predicted(df, model, "p").collect()}
    assert own[-1] is None and own[-2] is None and own[7] == pytest.approx(model.predict(x[7:8])[0])


def test_boosting_and_forests_fit_better_than_a_tree(mixed):
    df, x, y = mixed
    error = lambda m: ((m.predict(x) - y) ** 2).mean()
    stump = trees.decision_tree(df, "y", ["a", "b", "c"], depth=1)
    boosted = trees.gradient_boosting(df, "y", ["a", "b", "c"], trees=15, depth=3, step=0.3)
    assert error(boosted) < 0.1 < error(stump)
    forest = trees.random_forest(df, "y", ["a", "b", "c"], "id", trees=6, depth=5, share=0.7)
    assert error(forest) < error(stump) and len({str(as_paths(t)) for t in forest.trees}) == 6
    again = trees.random_forest(df.repartition(5), "y", ["a", "b", "c"], "id", trees=6, depth=5, share=0.7)
    assert [as_paths(t).keys() for t in again.trees] == [as_paths(t).keys() for t in forest.trees]
    chance = trees.gradient_boosting(df, "z", ["a", "b", "c"], trees=15, depth=3, step=0.5, logistic=True).predict(x)
    assert ((chance > 0.5) == (y > 2.5)).mean() > 0.97 and (chance > 0).all() and (chance < 1).all()
    with pytest.raises(ValueError):
        trees.gradient_boosting(df.filter("z = 1"), "z", ["a"], logistic=True)


# ------------------------------------------------------------------ feature selection


def test_feature_scores_of_all_columns(spark):
    rows = [(t, a, b, None) for t, a, b in [("x", "1", 5), ("x", "1", 5), ("y", "2", 5), ("y", "2", 5), ("y", None, 5), (None, "1", 5), ("x", "2", 5)]]
    df = spark.createDataFrame(rows, "t string, a string, b int, n string")
    got = {r.column: r for r in selection.feature_scores(df, "t", ["a", "b", "n"]).collect()}
    assert got["a"].n == 5 and got["a"].levels == 2 and got["a"].dof == 1
    assert got["a"].chi_square == pytest.approx(5 * (2 * 2 - 0 * 1) ** 2 / (3 * 2 * 2 * 3))
    assert got["b"].chi_square == 0 and got["b"].mutual_information == 0 and got["b"].p_value is None and got["n"].chi_square is None and got["n"].n == 0
    assert 0 < got["a"].p_value < 1 and got["a"].cramers_v == pytest.approx((got["a"].chi_square / 5) ** 0.5)
    assert selection.select_features(df, "t", ["b", "n", "a"], 1) == ["a"]


# ------------------------------------------------------------------ likelihood


def test_score_equations_vanish_for_every_group(spark):
    rng = np.random.default_rng(12)
    rows, own = [], {}
    for g in range(40):
        shape, scale = rng.uniform(0.3, 30), 10 ** rng.uniform(-3, 3)
        own[f"g{g}"] = {
            "gamma": rng.gamma(shape, scale, 60), "weibull": rng.weibull(shape / 5 + 0.2, 60) * scale, "beta": rng.beta(shape / 9, rng.uniform(0.3, 9), 60), "normal": rng.normal(shape, scale, 60),
            "lognormal": rng.lognormal(1, scale**0.1, 60), "exponential": rng.exponential(scale, 60), "poisson": rng.poisson(shape, 60).astype(float),
        }
        rows += [(f"g{g}", f, float(v)) for f, values in own[f"g{g}"].items() for v in values]
    rows += [("same", f, 0.5) for f in likelihood.FAMILIES for _ in range(3)] + [("bad", "gamma", -1.0), (None, "gamma", 2.0), (None, "gamma", 3.0), ("g1", "gamma", None)]
    df = spark.createDataFrame(rows, "g string, f string, x double").repartition(3).cache()
    for family in likelihood.FAMILIES:
        got = {r.g: r for r in likelihood.fit(df.filter(F.col("f") == family), "x", family, ["g"]).collect()}
        assert len(got) == (42 if family == "gamma" else 40 if family == "poisson" else 41)
        for g, values in own.items():
            x, r = values[family], got[g]
            x = x[(x > 0) & (x < 1)] if family == "beta" else x
            assert r.n == len(x)
            log_gamma = np.vectorize(__import__("math").lgamma)
            like = {
                "gamma": lambda k, b: (k * np.log(b) - log_gamma(k) + (k - 1) * np.log(x) - b * x).sum(),
                "weibull": lambda k, s: (np.log(k / s) + (k - 1) * np.log(x / s) - (x / s) ** k).sum(),
                "beta": lambda a, b: (log_gamma(a + b) - log_gamma(a) - log_gamma(b) + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)).sum(),
                "normal": lambda m, s: (-np.log(s) - 0.5 * np.log(2 * np.pi) - (x - m) ** 2 / (2 * s * s)).sum(),
                "lognormal": lambda m, s: (-np.log(x * s) - 0.5 * np.log(2 * np.pi) - (np.log(x) - m) ** 2 / (2 * s * s)).sum(),
                "exponential": lambda b: (np.log(b) - b * x).sum(),
                "poisson": lambda m: (x * np.log(m) - m - log_gamma(x + 1)).sum(),
            }[family]
            values = [r[i] for i in range(2, len(r) - 1)]
            top = like(*values)
            assert r.log_likelihood == pytest.approx(top, rel=1e-7, abs=1e-6)
            for i in range(len(values)):
                for step in (1.001, 0.999):
                    other = list(values)
                    other[i] *= step
                    assert like(*other) < top + 1e-7 * abs(top)
        if family in ("gamma", "weibull", "beta"):
            assert got["same"][2] is None and got["same"].log_likelihood is None
    whole = likelihood.fit(df.filter("f = 'gamma'"), "x", "gamma").first()
    assert whole.n == 40 * 60 + 5 and whole.shape > 0
    assert likelihood.fit(df.limit(0), "x", "weibull", ["g"]).count() == 0


def test_tukey_against_fixed_table_values(spark):
    from sparkloom.concepts import tukey
    from sparkloom.stats import distributions as D

    # q, groups, degrees of freedom: the published 5 % and 1 % points
    for q, k, dof, p in ((3.877, 3, 10, 0.05), (3.635, 2, 5, 0.05), (4.232, 5, 20, 0.05), (5.502, 4, 12, 0.01), (4.646, 10, 60, 0.05), (8.331, 3, 2, 0.05)):
        assert D.studentized_range_sf(q, k, dof) == pytest.approx(p, rel=2e-3)
    assert D.studentized_range_sf(3.0, 2, 7) == pytest.approx(D.t_two_sided(3.0 / 2**0.5, 7), rel=1e-9)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 6.0), ("c", 2.0), ("d", None), (None, 1.0)], "g string, x double")
    got = {(r.a, r.b): r for r in tukey(df, "x", "g").collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")} and got["a", "b"].difference == -3
    assert got["a", "b"].q_statistic == pytest.approx(3 / (4 / 3 / 2 * (1 / 3 + 1 / 2)) ** 0.5)
    assert got["a", "c"].p_value == pytest.approx(1) and 0 < got["a", "b"].p_value < got["b", "c"].p_value < 1


# ------------------------------------------------------------------ generalized linear models, engineered features


@pytest.mark.parametrize("family", ["gaussian", "binomial", "poisson", "gamma"])
def test_generalized_linear_models_solve_their_score_equations(spark, family):
    from sparkloom.models import glm

    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 2)) * [1, 5] + [0, 40]
    eta = 0.3 + x @ [0.5, -0.02]
    y = {"gaussian": eta + rng.normal(size=300), "binomial": (rng.random(300) < 1 / (1 + np.exp(-eta))).astype(float), "poisson": rng.poisson(np.exp(eta)).astype(float), "gamma": rng.gamma(3, np.exp(eta) / 3)}[family]
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0), (1.0, 1.0, float("nan")), (1.0, 1.0, -4.0)][: 2 if family == "gaussian" else 3]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    got = glm.generalized_linear_model(df, "y", ["a", "b"], family)
    z = np.column_stack([np.ones(300), x])
    b = np.array([got["coefficients"][k] for k in ("const", "a", "b")])
    e = z @ b
    mu = {"gaussian": e, "binomial": 1 / (1 + np.exp(-e))}.get(family, np.exp(e))
    score = {"gamma": (y - mu) / mu}.get(family, y - mu)
    assert got["n"] == 300 and np.abs(z.T @ score / 300).max() < 1e-5 * np.abs(z).max()
    w = {"gaussian": np.ones(300), "binomial": mu * (1 - mu), "poisson": mu, "gamma": np.ones(300)}[family]
    v = {"gaussian": np.ones(300), "binomial": mu * (1 - mu), "poisson": mu, "gamma": mu * mu}[family]
    dispersion = 1.0 if family in ("binomial", "poisson") else ((y - mu) ** 2 / v).sum() / 297
    assert got["dispersion"] == pytest.approx(dispersion, rel=1e-6)
    errors = np.sqrt(np.diag(np.linalg.inv((z * w[:, None]).T @ z)) * dispersion)
    assert np.allclose([got["std_errors"][k] for k in ("const", "a", "b")], errors, rtol=1e-4)
    assert got["deviance"] < got["null_deviance"] and got["p_values"]["a"] < 0.01
    with pytest.raises(ValueError):
        glm.generalized_linear_model(df.limit(2), "y", ["a", "b"], family)


def test_engineered_features(spark):
    import datetime as dt

    from sparkloom.models import features

    rows = [(1.0, dt.date(2024, 1, 1), "a b", True, 5), (3.0, None, "a b", None, 5), (None, dt.date(2024, 12, 29), "c", False, 5), (float("nan"), dt.date(2024, 1, 2), None, False, 5)]
    df = spark.createDataFrame(rows, "x double, d date, s string, f boolean, k int").coalesce(1)
    got = features.engineered(df, df.columns, 1).collect()
    assert [r.x_z for r in got] == [-1, 1, 0, 0] and [r.x_missing for r in got] == [0, 0, 1, 1] and got[1].x_log == pytest.approx(np.log(4))
    assert [(r.d_year, r.d_month, r.d_weekday) for r in got] == [(2024, 1, 1), (None, None, None), (2024, 12, 7), (2024, 1, 2)]
    assert [r.s_is_a_b for r in got] == [1, 1, 0, 0] and [r.s_length for r in got] == [3, 3, 1, None] and "s_is_c" not in got[0]
    assert [r.f_flag for r in got] == [1, None, 0, 0] and [r.f_missing for r in got] == [0, 1, 0, 0] and [r.k_z for r in got] == [0] * 4
    assert "d_hour" not in got[0] and features.engineered(df.limit(0), ["x", "s"]).count() == 0
