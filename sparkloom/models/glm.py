"""Generalized linear models by iteratively weighted least squares: a pass for each step."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..stats import distributions as D
from .passes import added, complete, number


@dataclass(frozen=True)
class Family:
    """A family with its link: mean of eta, its derivative, variance and unit deviance of (y, mean), and what y may be."""

    mean: object
    slope: object
    variance: object
    deviance: object
    eta: object
    able: object
    fixed: bool  # the dispersion is 1


def _xlog(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a log(a / b), 0 where a is."""
    return np.where(a > 0, a * np.log(np.where(a > 0, a, 1) / b), 0.0)


_exp = lambda e: np.exp(np.clip(e, -700, 700))
_logistic = lambda e: 1 / (1 + np.exp(-np.clip(e, -35, 35)))

FAMILIES = {
    "gaussian": Family(lambda e: e, np.ones_like, np.ones_like, lambda y, m: (y - m) ** 2, lambda m: m, lambda y: F.lit(True), False),
    "binomial": Family(
        _logistic, lambda e: _logistic(e) * (1 - _logistic(e)), lambda m: m * (1 - m), lambda y, m: 2 * (_xlog(y, m) + _xlog(1 - y, 1 - m)), lambda m: np.log(m / (1 - m)), lambda y: y.between(0, 1), True
    ),
    "poisson": Family(_exp, _exp, lambda m: m, lambda y, m: 2 * (_xlog(y, m) - (y - m)), np.log, lambda y: y >= 0, True),
    "gamma": Family(_exp, _exp, lambda m: m * m, lambda y, m: 2 * ((y - m) / m - np.log(y / m)), np.log, lambda y: y > 0, False),
}


def generalized_linear_model(df: DataFrame, y: str, x, family: str = "poisson", rounds: int = 50, tolerance: float = 1e-10) -> dict:
    """Coefficients with a constant, their errors and tails, deviances and dispersion.

    Links are the identity (gaussian), the logit (binomial) and the logarithm
    (poisson, gamma).  The dispersion is 1 for binomial and poisson, else Pearson's; tails are normal
    for the former, Student's for the latter.  Rows with a null or NaN, or
    with a value that the family can't have, are left out.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown family: {family}")
    f, names = FAMILIES[family], compat.names(x)
    rows, k = complete(df, [*names, y]).filter(f.able(number(y))), len(names) + 1
    cells = [c for i, v in enumerate(names) for c in (F.avg(number(v)).alias(f"m{i}"), F.stddev_pop(number(v)).alias(f"s{i}"))]
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(number(y)).alias("y"), *cells).first()
    n = m["n"]
    if n <= k:
        raise ValueError("too few complete rows")
    shift, scale = np.array([m[f"m{i}"] for i in range(k - 1)]), np.array([m[f"s{i}"] or 1.0 for i in range(k - 1)])
    if family in ("binomial", "poisson") and (m["y"] <= 0 or family == "binomial" and m["y"] >= 1):
        raise ValueError("the outcomes are all alike")
    z = rows.select(F.lit(1.0).alias("one"), *[((number(c) - F.lit(float(a))) / F.lit(float(b))).alias(f"z{i}") for i, (c, a, b) in enumerate(zip(names, shift, scale))], number(y).alias("y"))

    def sums(b: np.ndarray):
        def of(a: np.ndarray) -> np.ndarray:
            own, t = a[:, :k], a[:, k]
            eta = own @ b
            mu, slope = f.mean(eta), f.slope(eta)
            v = f.variance(mu)
            out = np.zeros((k + 2, k))
            out[:k] = (own * (slope * slope / v)[:, None]).T @ own
            out[k] = own.T @ ((t - mu) * slope / v)
            out[k + 1, 0] = f.deviance(t, mu).sum()
            out[k + 1, min(1, k - 1)] += ((t - mu) ** 2 / v).sum() if k > 1 else 0.0
            return out

        return added(z, of, (k + 2, k))

    beta = np.zeros(k)
    beta[0] = float(f.eta(np.float64(m["y"])))
    got = sums(beta)
    null = got[k + 1, 0]
    done = 0
    for done in range(1, rounds + 1):
        step = np.linalg.lstsq(got[:k], got[k], rcond=None)[0]
        for cut in (1.0, 0.5, 0.25, 0.1):
            new = sums(beta + cut * step)
            if new[k + 1, 0] <= got[k + 1, 0] * (1 + 1e-12) + 1e-12:
                break
        beta, last, got = beta + cut * step, got[k + 1, 0], new
        if abs(last - got[k + 1, 0]) <= tolerance * (abs(last) + 1e-9):
            break
    deviance = float(got[k + 1, 0])
    pearson = float(got[k + 1, 1]) if k > 1 else deviance
    dispersion = 1.0 if f.fixed else pearson / (n - k)
    turn = np.eye(k)
    turn[0, 1:] = -shift / scale
    turn[1:, 1:] = np.diag(1 / scale)
    own = turn @ beta
    error = np.sqrt(np.maximum(np.diag(turn @ np.linalg.pinv(got[:k]) @ turn.T) * dispersion, 0))
    ratio = own / np.where(error > 0, error, np.nan)
    tails = [2 * D.normal_sf(abs(t)) if f.fixed else D.t_two_sided(t, n - k) for t in ratio]
    by = lambda a: dict(zip(["const", *names], map(float, a)))
    return {
        "n": n, "coefficients": by(own), "std_errors": by(error), "statistics": by(ratio), "p_values": by(tails),
        "deviance": deviance, "null_deviance": float(null), "dispersion": dispersion, "rounds": done,
    }
