"""Tails of the test distributions, on single numbers."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By Newton steps on the distribution function from a rough start."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5) if p in (0, 1) else math.nan
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    x = math.copysign(t - (2.30753 + 0.27061 * t) / (1 + t * (0.99229 + 0.04481 * t)), p - 0.5)
    for _ in range(60):
        step = (normal_cdf(x) - p) * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
        x -= max(-0.5, min(0.5, step))
        if abs(step) < 1e-15 * max(1, abs(x)):
            break
    return x


def normal_sf_array(z: np.ndarray) -> np.ndarray:
    """Upper tails of many numbers: a series of positive terms near zero, a continued fraction beyond."""
    x = np.abs(np.asarray(z, float)) / math.sqrt(2)
    near, out = x < 2.5, np.empty(x.shape)
    a = x[near]
    term = total = a.copy()
    for n in range(1, 60):
        term = term * (2 * a * a / (2 * n + 1))
        total = total + term
    out[near] = 1 - 2 / math.sqrt(math.pi) * np.exp(-a * a) * total
    b = x[~near]
    f = np.zeros_like(b)
    for k in range(60, 0, -1):
        f = k / 2 / (b + f)
    out[~near] = np.exp(-b * b) / math.sqrt(math.pi) / (b + f)
    return np.where(np.asarray(z) >= 0, out / 2, 1 - out / 2)


def normal_quantile_array(p: np.ndarray) -> np.ndarray:
    """Quantiles of many shares between 0 and 1, by Newton steps in the tail that is shorter."""
    p = np.asarray(p, float)
    tail = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(tail))
    x = t - (2.30753 + 0.27061 * t) / (1 + t * (0.99229 + 0.04481 * t))
    for _ in range(8):
        x = x + np.clip((normal_sf_array(x) - tail) * math.sqrt(2 * math.pi) * np.exp(x * x / 2), -0.5, 0.5)
    return np.where(p < 0.5, -x, x)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + top * d) or tiny)
        c = (1 + top / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-16:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else (0.0 if df > 0 and math.isinf(t) else math.nan)


def t_quantile(p: float, df: float) -> float:
    """Two-sided critical value: the t with ``p`` in both tails together."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_sf(f: float, d1: float, d2: float) -> float:
    if f == math.inf:
        return 0.0
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def kolmogorov_sf(d: float, n: int) -> float:
    """Asymptotic two-sided tail with the usual small-sample correction of the argument."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-z / math.sqrt(2))


def studentized_range_sf(q: float, groups: int, dof: float) -> float:
    """The chance of a range of ``groups`` normal means over their pooled deviation beyond ``q``.

    Gauss-Legendre sums over the deviation's distribution and, within, over the place of the smallest mean.
    """
    if q <= 0:
        return 1.0
    nodes, weights = np.polynomial.legendre.leggauss(64)
    z, wz = nodes * 9, weights * 9
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = _normal_cdf(z)

    def within(width: float) -> float:
        inner = np.maximum(upper - _normal_cdf(z - width), 0) ** (groups - 1)
        return float(min(1.0, groups * (wz * density * inner).sum()))

    if dof > 1e5:
        return max(0.0, 1 - within(q))
    spread = 9 / math.sqrt(2 * dof)
    low, high = max(1e-9, 1 - spread), 1 + spread * (1 + 3 / math.sqrt(dof))
    s, ws = (high + low) / 2 + nodes * (high - low) / 2, weights * (high - low) / 2
    log = math.log(2) + dof / 2 * math.log(dof / 2) - math.lgamma(dof / 2) + (dof - 1) * np.log(s) - dof * s * s / 2
    mass = ws * np.exp(log)
    return max(0.0, 1 - sum(m * within(q * v) for m, v in zip(mass, s)) / mass.sum())
