"""Penalised linear regression, cross-validation, tuning and learning curves from cross products.

One pass adds up the cross products of all columns, apart for each fold.  What is
fitted on some folds and judged on others then comes from sums and differences of
these small matrices: no further pass, however many folds and penalties there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from .passes import added, complete, number


@dataclass(frozen=True)
class Products:
    """Sums of z z' for z = (1, x - shift, y - shift), one matrix for each fold."""

    names: list[str]
    shift: np.ndarray
    sums: np.ndarray

    def of(self, folds: Sequence[int] | None = None) -> np.ndarray:
        return self.sums.sum(axis=0) if folds is None else self.sums[list(folds)].sum(axis=0)


def products(df: DataFrame, y: str, x, fold: str | None = None, folds: int = 1) -> Products:
    """Cross products of the complete rows, about the columns' means; ``fold`` holds numbers from 0 to ``folds`` - 1."""
    names = [*compat.names(x), y]
    rows = complete(df, names)
    if fold is not None:
        rows = rows.filter(compat.col(fold).between(0, folds - 1))
    means = rows.agg(*[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    if means[0] is None:
        raise ValueError("no complete rows")
    shift = np.array(list(means), float)
    k = len(names) + 1

    def sums(z: np.ndarray) -> np.ndarray:
        own = np.column_stack([np.ones(len(z)), z[:, 1:] - shift])
        out = np.zeros((folds, k, k))
        for f in np.unique(z[:, 0]).astype(int):
            part = own[z[:, 0] == f]
            out[f] = part.T @ part
        return out

    group = number(fold) if fold is not None else F.lit(0.0)
    cells = rows.select(group.alias("f"), *[number(c).alias(f"c{i}") for i, c in enumerate(names)])
    return Products(names[:-1], shift, added(cells, sums, (folds, k, k)))


@dataclass(frozen=True)
class Centred:
    """What a fit needs of the products: means, covariances, and the columns' scales."""

    n: float
    mean: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, standardize: bool) -> Centred:
        n = a[0, 0]
        if n < 1:
            raise ValueError("no rows to fit on")
        mean = a[0, 1:] / n
        cov = a[1:, 1:] / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
        scale = np.where(scale > 1e-12, scale, 1.0) if standardize else np.ones(len(scale))
        return cls(n, mean, cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale, scale)


def descend(gram: np.ndarray, cross: np.ndarray, penalty: float, mix: float, start: np.ndarray | None = None, rounds: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """Coordinate descent for b'Gb/2 - c'b + penalty * (mix |b| + (1 - mix) b'b / 2).

    Columns that nearly depend on one another make it slow; now and then the
    equations for the coefficients in use are solved outright, and if they are the answer, it ends.
    """
    if mix * penalty == 0:
        return np.linalg.lstsq(gram + penalty * np.eye(len(cross)), cross, rcond=None)[0]
    b = np.zeros(len(cross)) if start is None else start.copy()
    slope = gram @ b
    diagonal = np.diag(gram)
    for done in range(rounds):
        moved = 0.0
        for j in range(len(b)):
            width = diagonal[j] + penalty * (1 - mix)
            if width <= 0:
                continue
            pull = cross[j] - slope[j] + diagonal[j] * b[j]
            new = np.sign(pull) * max(abs(pull) - penalty * mix, 0.0) / width
            if new != b[j]:
                slope += gram[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]) * np.sqrt(max(diagonal[j], 1e-300)))
                b[j] = new
        if moved <= tolerance * max(1.0, np.abs(cross).max()):
            break
        if done % 20 == 19:
            b, ended = _solved(gram, cross, penalty, mix, b)
            if ended:
                break
            slope = gram @ b
    return b


def _solved(gram: np.ndarray, cross: np.ndarray, penalty: float, mix: float, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """Go to the minimum among coefficients of the signs of ``b``, a coefficient that would change its sign staying at 0; whether it is the one over all."""
    b = b.copy()
    while True:
        on = np.flatnonzero(b)
        sign = np.sign(b[on])
        own = gram[np.ix_(on, on)] + penalty * (1 - mix) * np.eye(len(on))
        goal = np.linalg.lstsq(own, cross[on] - penalty * mix * sign, rcond=None)[0]
        turned = np.flatnonzero(goal * sign <= 0)
        if not len(turned):
            b[on] = goal
            break
        way = b[on][turned] / (b[on][turned] - goal[turned])
        b[on] += way.min() * (goal - b[on])
        b[on[turned[way.argmin()]]] = 0.0
    pull = cross - gram @ b - penalty * (1 - mix) * b
    return b, bool((np.abs(pull[b == 0]) <= penalty * mix * (1 + 1e-9) + 1e-12).all())


def _penalties(cross: np.ndarray, mix: float, n: int = 50) -> list[float]:
    """From the smallest penalty that leaves no coefficient down to a thousandth of it."""
    top = np.abs(cross).max() / max(mix, 1e-3) if len(cross) else 1.0
    return [float(top * 1000 ** (-i / (n - 1))) for i in range(n)]


def _path(c: Centred, shift: np.ndarray, penalties: Sequence[float], mix: float) -> list[tuple[float, np.ndarray]]:
    """(constant, coefficients) for each penalty, in units of the columns; the constant isn't penalised."""
    out: dict[float, tuple[float, np.ndarray]] = {}
    b = None
    for penalty in sorted(set(penalties), reverse=True):
        b = descend(c.gram, c.cross, penalty, mix, b)
        own = b / c.scale
        mean = c.mean + shift
        out[penalty] = (float(mean[-1] - own @ mean[:-1]), own)
    return [out[p] for p in penalties]


def squared_error(a: np.ndarray, shift: np.ndarray, const: float, coefficients: np.ndarray) -> float:
    """The mean squared error of a fit on the rows of ``a``."""
    w = np.concatenate([[shift[-1] - const - coefficients @ shift[:-1]], -coefficients, [1.0]])
    return float(max(w @ a @ w, 0.0) / a[0, 0]) if a[0, 0] else float("nan")


def elastic_net(df: DataFrame, y: str, x, penalties: Sequence[float] | None = None, mix: float = 0.5, standardize: bool = True) -> list[dict]:
    """Coefficients along a path of penalties.

    Least is the mean squared error's half plus penalty * (mix * sum |b| + (1 - mix) / 2 * sum b^2),
    b being coefficients of standardised columns unless ``standardize`` is false.
    ``mix`` 1 is the lasso, 0 the ridge.  Constant columns get coefficient 0; rows with a
    null or NaN in a column are left out.
    """
    if not 0 <= mix <= 1:
        raise ValueError("the mix lies between 0 and 1")
    p = products(df, y, x)
    c = Centred.of(p.of(), standardize)
    penalties = list(_penalties(c.cross, mix) if penalties is None else penalties)
    if any(v < 0 for v in penalties):
        raise ValueError("a penalty isn't negative")
    return [
        {"penalty": penalty, "coefficients": {"const": const, **dict(zip(p.names, map(float, b)))}, "nonzero": int(np.count_nonzero(b)), "mse": squared_error(p.of(), p.shift, const, b)}
        for penalty, (const, b) in zip(penalties, _path(c, p.shift, penalties, mix))
    ]


def lasso(df: DataFrame, y: str, x, penalties: Sequence[float] | None = None, standardize: bool = True) -> list[dict]:
    return elastic_net(df, y, x, penalties, 1.0, standardize)


def ridge(df: DataFrame, y: str, x, penalties: Sequence[float] | None = None, standardize: bool = True) -> list[dict]:
    return elastic_net(df, y, x, penalties, 0.0, standardize)


def cross_validate(df: DataFrame, y: str, x, fold: str, folds: int, penalties: Sequence[float] | None = None, mixes: Sequence[float] = (1.0,), standardize: bool = True) -> dict:
    """Each fold's error under fits on the other folds, for every mix and penalty, and the best of them fitted on all rows.

    ``scores``: mix, penalty, fold, n, train_mse, test_mse; ``means``: mix, penalty, mean and
    standard error of the folds' test errors, each fold weighing its rows.  A fold without rows is
    left out.  ``frugal`` is the largest penalty whose mean is within one standard error of
    the best one's, for the same mix.
    """
    p = products(df, y, x, fold, folds)
    own = [f for f in range(folds) if p.sums[f, 0, 0] > 0]
    if len(own) < 2:
        raise ValueError("rows of two folds are needed")
    scores, means = [], []
    for mix in mixes:
        grid = list(_penalties(Centred.of(p.of(), standardize).cross, mix) if penalties is None else penalties)
        errors = np.zeros((len(own), len(grid)))
        for i, f in enumerate(own):
            train = p.of([g for g in own if g != f])
            for j, (const, b) in enumerate(_path(Centred.of(train, standardize), p.shift, grid, mix)):
                errors[i, j] = squared_error(p.sums[f], p.shift, const, b)
                scores.append({"mix": mix, "penalty": grid[j], "fold": f, "n": int(p.sums[f, 0, 0]), "train_mse": squared_error(train, p.shift, const, b), "test_mse": float(errors[i, j])})
        weight = p.sums[own, 0, 0] / p.sums[own, 0, 0].sum()
        mean = weight @ errors
        spread = np.sqrt(weight @ (errors - mean) ** 2 / max(len(own) - 1, 1))
        means += [{"mix": mix, "penalty": v, "mean_mse": float(m), "std_error": float(s)} for v, m, s in zip(grid, mean, spread)]
    best = min(means, key=lambda r: (r["mean_mse"], -r["penalty"]))
    near = [r for r in means if r["mix"] == best["mix"] and r["mean_mse"] <= best["mean_mse"] + best["std_error"]]
    const, b = _path(Centred.of(p.of(), standardize), p.shift, [best["penalty"]], best["mix"])[0]
    return {"scores": scores, "means": means, "best": best, "frugal": max(r["penalty"] for r in near), "coefficients": {"const": const, **dict(zip(p.names, map(float, b)))}}


def learning_curve(df: DataFrame, y: str, x, part: str, parts: int, penalty: float = 0.0, mix: float = 0.0, standardize: bool = True) -> list[dict]:
    """Errors of fits on growing shares of the rows: parts 1, then 1 and 2, and so on, all judged on part 0.

    ``part`` is a number from 0 to ``parts`` - 1, such as a hash of a key modulo ``parts``.
    """
    p = products(df, y, x, part, parts)
    out = []
    for last in range(1, parts):
        train = p.of(range(1, last + 1))
        if train[0, 0] and p.sums[0, 0, 0]:
            const, b = _path(Centred.of(train, standardize), p.shift, [penalty], mix)[0]
            out.append({"n": int(train[0, 0]), "train_mse": squared_error(train, p.shift, const, b), "test_mse": squared_error(p.sums[0], p.shift, const, b)})
    return out
