"""Clusters and components of vectors: k-means, silhouettes, principal components.

Vectors are one column of equally long arrays of numbers.  Every step is a pass
in which each task gives one small array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat
from ..session import share_package
from .passes import added, vectors

#: Components of vectors up to this long come from their covariances; longer ones from products with few directions.
WHOLE_COVARIANCE = 1024


def _size(v: DataFrame) -> int:
    sizes = v.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if sizes["lo"] is None:
        raise ValueError("no vectors")
    if sizes["lo"] != sizes["hi"]:
        raise ValueError("the vectors aren't equally long")
    return sizes["hi"]


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def assign(df: DataFrame, column: str, centres: np.ndarray, name: str = "cluster", distance: str | None = None) -> DataFrame:
    """``df`` with the number of the nearest centre (of several the first), and its squared distance; null without a vector."""
    share_package(df.sparkSession)

    @F.pandas_udf("struct<c: int, d: double>")
    def nearest(v):
        import pandas as pd

        out = pd.DataFrame({"c": pd.array([None] * len(v), "Int32"), "d": [np.nan] * len(v)})
        own = v.notna().to_numpy()
        if own.any():
            d = distances(np.stack(v[own].to_list()), centres)
            out.loc[own, "c"], out.loc[own, "d"] = d.argmin(1), d.min(1)
        return out

    found = df.withColumn("__near", nearest(compat.col(column).cast(T.ArrayType(T.DoubleType()))))
    cells = {name: F.col("__near.c")} | ({distance: F.when(F.col("__near.c").isNotNull(), F.col("__near.d"))} if distance else {})
    return found.withColumns(cells).drop("__near")


def seed_centres(v: DataFrame, k: int, rounds: int = 5, seed: int = 0) -> np.ndarray:
    """Centres by oversampling: in each round a row is drawn with a chance in proportion to its distance from those drawn so far.

    Some 2 k rows are drawn in a round; those drawn weigh the rows that they are
    nearest to, and k of them are chosen by weighted k-means on the driver, which
    holds 2 k (rounds + 1) rows at most, or so.
    """
    first = v.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(1).collect()
    if not first:
        raise ValueError("no vectors")
    centres = np.array([first[0]["v"]], float)
    for r in range(rounds):
        cost = added(v, lambda x, c=centres: np.array([distances(x, c).min(1).sum()]), (1,))[0]
        if cost <= 0:
            break
        far = assign(v, "v", centres, "c", "d")
        chance = F.pmod(F.xxhash64("v", F.lit(seed * 1000 + r)), F.lit(1 << 40)) / float(1 << 40)
        drawn = far.filter(chance < F.lit(2 * k / cost) * F.col("d")).select("v").distinct().collect()
        if drawn:
            centres = np.vstack([centres, np.array([d["v"] for d in drawn], float)])
    centres = np.unique(centres, axis=0)
    if len(centres) <= k:
        return centres
    near = lambda x: np.bincount(distances(x, centres).argmin(1), minlength=len(centres)).astype(float)
    return _weighted(centres, added(v, near, (len(centres),)), k, seed)


def _weighted(x: np.ndarray, w: np.ndarray, k: int, seed: int, tries: int = 20) -> np.ndarray:
    """k-means of few weighted rows: the best of some tries."""
    rng = np.random.default_rng(seed)
    w = np.maximum(w, 1e-9)
    best, least = x[:k], np.inf
    for _ in range(tries):
        own = [int(rng.choice(len(x), p=w / w.sum()))]
        while len(own) < k:
            p = w * distances(x, x[own]).min(1)
            own.append(int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 0 else int(rng.integers(len(x))))
        centres = x[own]
        for _ in range(30):
            near = distances(x, centres).argmin(1)
            new = np.array([np.average(x[near == j], axis=0, weights=w[near == j]) if (near == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres, atol=1e-12):
                break
            centres = new
        cost = w @ distances(x, centres).min(1)
        if cost < least:
            best, least = centres, cost
    return best


def k_means(df: DataFrame, column: str, k: int, rounds: int = 100, start: Sequence[Sequence[float]] | None = None, seed: int = 0, tolerance: float = 1e-9) -> dict:
    """Lloyd's steps until the centres stand still: centres, sizes, cost (squared distances added up) and rounds.

    Null vectors are left out; a centre that no row is nearest to stays where it
    is.  Fewer distinct rows than ``k`` give fewer centres.
    """
    v = vectors(df, column)
    size = _size(v)
    centres = np.array(start, float) if start is not None else seed_centres(v, k, seed=seed)
    if centres.shape[1:] != (size,):
        raise ValueError("a centre is as long as the vectors")
    n = len(centres)

    def sums(x: np.ndarray) -> np.ndarray:
        d = distances(x, centres)
        near = d.argmin(1)
        out = np.zeros((n, size + 2))
        np.add.at(out[:, :size], near, x)
        out[:, size] = np.bincount(near, minlength=n)
        out[:, size + 1] = np.bincount(near, weights=d.min(1), minlength=n)
        return out

    done = 0
    got = added(v, sums, (n, size + 2))
    while done < rounds:
        counts = got[:, size]
        moved = np.where(counts[:, None] > 0, got[:, :size] / np.maximum(counts, 1)[:, None], centres)
        still = np.abs(moved - centres).max() <= tolerance
        centres, done = moved, done + 1
        got = added(v, sums, (n, size + 2))
        if still:
            break
    return {"centres": centres.tolist(), "sizes": got[:, size].astype(int).tolist(), "cost": float(got[:, size + 1].sum()), "rounds": done}


def silhouette(df: DataFrame, column: str, cluster: str, name: str = "silhouette") -> DataFrame:
    """``df`` with each row's silhouette for squared distances; no pairs are formed.

    A row's mean squared distance from a cluster comes from the row, the cluster's mean and
    its mean squared length.  It is 0 in a cluster of one and null without a vector or a
    cluster, or if there is one cluster only.  Clusters' means are held by each task.
    """
    share_package(df.sparkSession)
    own = df.filter(compat.col(column).isNotNull() & compat.col(cluster).isNotNull())
    v = own.select(compat.col(column).cast(T.ArrayType(T.DoubleType())).alias("v"), compat.col(cluster).alias("c"))
    labels = sorted(r["c"] for r in v.select("c").distinct().collect())
    if len(labels) < 2:
        return df.withColumn(name, F.lit(None).cast("double"))
    size = _size(v.select("v"))
    place = F.create_map(*[x for i, c in enumerate(labels) for x in (F.lit(c), F.lit(float(i)))])
    rows = v.select(F.concat(F.array(place[F.col("c")]), "v").alias("v"))
    n = len(labels)

    def moments(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, size + 2))
        c = x[:, 0].astype(int)
        np.add.at(out[:, :size], c, x[:, 1:])
        out[:, size] = np.bincount(c, weights=(x[:, 1:] ** 2).sum(1), minlength=n)
        out[:, size + 1] = np.bincount(c, minlength=n)
        return out

    m = added(rows, moments, (n, size + 2))
    counts = m[:, size + 1]
    means, squares = m[:, :size] / counts[:, None], m[:, size] / counts

    @F.pandas_udf("double")
    def score(v, c):
        import pandas as pd

        out = np.full(len(v), np.nan)
        ok = (v.notna() & c.notna()).to_numpy()
        if ok.any():
            x, j = np.stack(v[ok].to_list()), c[ok].to_numpy().astype(int)
            d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ means.T + squares, 0)
            row = np.arange(len(x))
            inner = d[row, j] * counts[j] / np.maximum(counts[j] - 1, 1)
            d[row, j] = np.inf
            outer = d.min(1)
            most = np.maximum(inner, outer)
            out[ok] = np.where(counts[j] > 1, np.where(most > 0, (outer - inner) / np.where(most > 0, most, 1), 0.0), 0.0)
        return pd.Series(out)

    scored = score(compat.col(column).cast(T.ArrayType(T.DoubleType())), place[compat.col(cluster)])
    return df.withColumn(name, F.when(F.isnan(scored), None).otherwise(scored))


def _moments(v: DataFrame, size: int) -> tuple[float, np.ndarray]:
    got = added(v, lambda x: np.concatenate([[len(x)], x.sum(0)]), (size + 1,))
    return got[0], got[1:] / got[0]


def principal_components(df: DataFrame, column: str, k: int = 2, rounds: int = 300, tolerance: float = 1e-9, whole: int | None = None) -> dict:
    """mean, components (unit vectors, the largest entry positive), variances, shares of the whole variance, and residuals.

    Short vectors' components come from one pass that adds up covariances.  For
    vectors longer than ``WHOLE_COVARIANCE``, a block of a few more directions than ``k`` is
    multiplied by the covariances, row by row, and made orthogonal, until it stands still.
    ``residuals`` are the lengths of C v - variance v, in units of the largest variance.
    """
    v = vectors(df, column)
    size = _size(v)
    n, mean = _moments(v, size)
    k = min(k, size)
    if n < 2:
        raise ValueError("two vectors are needed")
    if size <= (WHOLE_COVARIANCE if whole is None else whole):
        cov = added(v, lambda x: (x - mean).T @ (x - mean), (size, size)) / (n - 1)
        values, basis = np.linalg.eigh(cov)
        values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
        product, total = cov @ basis, float(np.trace(cov))
    else:
        width = min(size, k + 8)
        block = np.linalg.qr(np.random.default_rng(0).normal(size=(size, width)))[0]
        total = added(v, lambda x: np.array([((x - mean) ** 2).sum()]), (1,))[0] / (n - 1)
        for _ in range(rounds):
            product = added(v, lambda x, b=block: (x - mean).T @ ((x - mean) @ b), (size, width)) / (n - 1)
            values, turn = np.linalg.eigh(block.T @ product)
            order = np.argsort(-values)
            values, basis, product = values[order], block @ turn[:, order], product @ turn[:, order]
            left = np.linalg.norm(product[:, :k] - basis[:, :k] * values[:k], axis=0)
            if left.max() <= tolerance * max(values[0], 1e-300):
                break
            block = np.linalg.qr(product)[0]
        values, basis, product = values[:k], basis[:, :k], product[:, :k]
    residual = np.linalg.norm(product - basis * values, axis=0) / max(values[0], 1e-300)
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(k)])
    return {
        "mean": mean.tolist(), "components": (basis * signs).T.tolist(), "variances": values.tolist(),
        "shares": (values / total if total else values * 0).tolist(), "residuals": residual.tolist(),
    }


def projected(df: DataFrame, column: str, fit: dict, name: str = "scores") -> DataFrame:
    """``df`` with the coordinates of its vectors along the components, as an array."""
    own, mean = compat.col(column).cast(T.ArrayType(T.DoubleType())), fit["mean"]
    centred = F.zip_with(own, F.array(*map(F.lit, mean)), lambda a, b: a - b)
    dot = lambda c: F.aggregate(F.zip_with(centred, F.array(*map(F.lit, c)), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    return df.withColumn(name, F.when(own.isNotNull(), F.array(*[dot(c) for c in fit["components"]])))
