"""Quantile regression: Newton steps on a smoothed loss, then an exact finish on the rows near the fit.

The loss's minimum is a plane through as many rows as it has coefficients.
Smoothing the loss over a shrinking width brings the fit near it by
passes that add up a matrix.  Then only rows near the plane are undecided: they are few, they
are fetched, and the others count by the sum of their pulls.  A last pass tells
whether any of these others has changed sides; if so, more rows are taken as undecided.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from .passes import added, complete, number

#: Rows that are undecided at a time; the driver holds their numbers.
UNDECIDED = 20_000


def _pull(z: np.ndarray, beta: np.ndarray, share: float, width: float) -> np.ndarray:
    """Gradient (row 0) and Hessian of a batch, the step in the loss's slope being smoothed by a logistic curve."""
    x, y = z[:, :-1], z[:, -1]
    below = 1 / (1 + np.exp(-np.clip((x @ beta - y) / width, -40, 40)))
    return np.vstack([(below - share) @ x, (x * (below * (1 - below) / width)[:, None]).T @ x])


def _vertex(x: np.ndarray, y: np.ndarray, w: np.ndarray, share: float, pull: np.ndarray, start: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """The exact minimum of the sum of w * loss(y - x b) + pull b, from vertex to vertex.

    At a vertex, as many rows as coefficients lie on the plane; letting one of them
    go gives an edge.  Along an edge that falls, the minimum is where the slopes
    of the passed rows have made up for it.  Rows are moved by less than matters, so
    that no more of them than coefficients meet in a vertex.
    """
    k = x.shape[1]
    exact, y = y, y + 1e-8 * np.random.default_rng(1).uniform(-1, 1, len(y))
    basis: list[int] = []
    for i in np.argsort(np.abs(y - x @ start), kind="stable"):
        if np.linalg.matrix_rank(x[[*basis, i]]) > len(basis):
            basis.append(int(i))
        if len(basis) == k:
            break
    if len(basis) < k:
        raise ValueError("the columns depend on one another")
    for _ in range(rounds):
        inverse = np.linalg.inv(x[basis])
        beta = inverse @ y[basis]
        residual = y - x @ beta
        residual[basis] = 0.0
        scale = 1e-13 * (1 + np.abs(y))
        side = np.where(residual > scale, -share, np.where(residual < -scale, 1 - share, 0.0)) * w
        side[basis] = 0.0
        free = np.abs(residual) <= scale
        free[basis] = False
        best, edge = -1e-9 * max(1.0, np.abs(w).max()), None
        for j in range(k):
            for sign in (1.0, -1.0):
                d = sign * inverse[:, j]
                along = x @ d
                # rows on the plane resist whichever way they are passed
                slope = pull @ d + side @ along + (w[free] * np.where(along[free] > 0, (1 - share) * along[free], -share * along[free])).sum()
                slope += w[basis[j]] * ((1 - share) if sign > 0 else share)
                if slope < best:
                    best, edge = slope, (j, d, along)
        if edge is None:
            return inverse @ exact[basis]
        j, d, along = edge
        slope = best
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(np.abs(along) > 1e-14, residual / along, np.inf)
        ahead = np.flatnonzero((step > 0) & np.isfinite(step) & ~free)
        ahead = np.array([i for i in ahead[np.argsort(step[ahead], kind="stable")] if i not in basis])
        for i in ahead:
            slope += w[i] * abs(along[i])
            if slope >= 0:
                basis[j] = int(i)
                break
        else:
            raise ValueError("the loss has no minimum; the columns depend on one another")
    raise ValueError("no vertex was found to be the minimum")


def quantile_regression(df: DataFrame, y: str, x, share: float = 0.5, undecided: int = UNDECIDED) -> dict:
    """Coefficients of the ``share`` quantile of y given x, with a constant.

    Returns n, coefficients, loss (the mean of the check loss), below, on and
    above (rows by their side of the plane).  Where several planes are equally good, one
    of them comes out.  Rows with a null or NaN are left out.  Few values that very many rows
    share are no trouble: equal rows are counted, not fetched.
    """
    if not 0 < share < 1:
        raise ValueError("the share lies between 0 and 1")
    names = compat.names(x)
    rows, k = complete(df, [*names, y]), len(names) + 1
    cells = [c for i, v in enumerate([*names, y]) for c in (F.avg(number(v)).alias(f"m{i}"), F.stddev_pop(number(v)).alias(f"s{i}"))]
    m = rows.agg(F.count(F.lit(1)).alias("n"), *cells).first()
    if m["n"] <= k:
        raise ValueError("too few complete rows")
    mean = np.array([m[f"m{i}"] for i in range(k)])
    scale = np.array([m[f"s{i}"] or 1.0 for i in range(k)])
    if any(m[f"s{i}"] == 0 for i in range(k - 1)):
        raise ValueError("a column is constant")
    z = rows.select(F.lit(1.0).alias("one"), *[((number(c) - F.lit(float(mean[i]))) / F.lit(float(scale[i]))).alias(f"z{i}") for i, c in enumerate([*names, y])])
    beta = np.zeros(k)
    width, last = 1.0, 0.02 * min(1.0, 10 * (undecided / m["n"]) ** 0.5)
    while True:
        beta = _newton(z, beta, share, width, k, 8 if width <= last else 3)
        if width <= last:
            break
        width = max(width / 3, last)
    near = width
    columns = z.columns
    while True:
        fit = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, columns[:-1])), F.lit(0.0))
        residual = F.col(columns[-1]) - fit
        groups = z.filter(F.abs(residual) <= near).groupBy(*columns).agg(F.count("*").alias("w")).limit(undecided + 1).toPandas().to_numpy(float)
        if len(groups) > undecided:
            near /= 4
            if near < 1e-13:
                raise ValueError("too many different rows lie on the plane")
            continue
        side = F.when(residual > near, -share).when(residual < -near, 1 - share).otherwise(0.0)
        pull = np.array(list(z.agg(*[F.sum(side * F.col(c)) for c in columns[:-1]]).first()), float)
        try:
            new = _vertex(groups[:, :k], groups[:, k], groups[:, -1], share, pull, beta) if len(groups) >= k else None
        except ValueError:
            new = None
        if new is not None:
            moved = sum((F.lit(float(b)) * F.col(c) for b, c in zip(new, columns[:-1])), F.lit(0.0))
            after = F.col(columns[-1]) - moved
            crossed = z.agg(F.sum(((residual > near) & (after < 0) | (residual < -near) & (after > 0)).cast("long"))).first()[0]
            if not crossed:
                beta = new
                break
            beta = new
        if near > 1e6:
            raise ValueError("the columns depend on one another")
        near *= 2 if len(groups) < undecided // 4 else 1.3
    fit = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, columns[:-1])), F.lit(0.0))
    r = F.col(columns[-1]) - fit
    on = F.abs(r) <= 1e-9
    s = z.agg(
        F.sum(F.when(r >= 0, r * share).otherwise(r * (share - 1))).alias("loss"), F.sum((on).cast("long")).alias("on"),
        F.sum((~on & (r < 0)).cast("long")).alias("below"), F.sum((~on & (r > 0)).cast("long")).alias("above"),
    ).first()
    slopes = beta[1:] * scale[-1] / scale[:-1]
    const = mean[-1] + scale[-1] * beta[0] - slopes @ mean[:-1]
    return {
        "n": m["n"], "coefficients": {"const": float(const), **dict(zip(names, map(float, slopes)))}, "loss": float(s["loss"] * scale[-1] / m["n"]),
        "below": s["below"], "on": s["on"], "above": s["above"],
    }


def _newton(z: DataFrame, beta: np.ndarray, share: float, width: float, k: int, rounds: int) -> np.ndarray:
    """Steps at one width; a step is cut where the gradient would grow."""
    g = added(z, lambda a: _pull(a, beta, share, width), (k + 1, k))
    for _ in range(rounds):
        size, ridge = np.abs(g[0]).max(), 1e-9 * max(np.trace(g[1:]), 1e-300)
        step = np.linalg.lstsq(g[1:] + ridge * np.eye(k), g[0], rcond=None)[0]
        for cut in (1.0, 0.3, 0.1, 0.03):
            trial = beta - cut * step
            new = added(z, lambda a, b=trial: _pull(a, b, share, width), (k + 1, k))
            if np.abs(new[0]).max() < size:
                break
        else:
            return beta
        beta, g = trial, new
        if np.abs(cut * step).max() < width / 50:
            break
    return beta
