"""Trees over histograms: single trees, forests and boosting.

Columns are cut into bins at quantiles once.  A level of a tree is one aggregate
over the rows: sums of gradients by (node, column, bin) that each task adds up
in one array; the best split of each node comes from these.  Rows aren't
moved: a task finds a row's node by going down the trees grown so far.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..operators import ordered
from ..session import share_package
from .passes import added, complete, number

BINS = 32


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has feature -1; rows with a value up to the threshold go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: float, gain: float) -> tuple[int, int]:
        own = len(self.feature)
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            column += [v, v]
        self.feature[node], self.threshold[node], self.left[node], self.right[node], self.gain[node] = feature, threshold, own, own + 1, gain
        return own, own + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right))
        at, row = np.zeros(len(x), int), np.arange(len(x))
        while (feature[at] >= 0).any():
            go = x[row, feature[at]] <= threshold[at]
            at = np.where(feature[at] < 0, at, np.where(go, left[at], right[at]))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]


@dataclass
class Model:
    """Trees whose values are added to ``base``; ``link`` turns the sum into a chance."""

    names: list[str]
    base: float
    trees: list[Tree]
    logistic: bool = False
    mean: bool = False

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            total += t.predict(x)
        return self.base + (total / max(len(self.trees), 1) if self.mean else total)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x))) if self.logistic else self.raw(x)

    def importance(self) -> dict[str, float]:
        """Each column's share in the gain of all splits."""
        gain = dict.fromkeys(self.names, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gain[self.names[f]] += g
        total = sum(gain.values())
        return {k: v / total if total else 0.0 for k, v in gain.items()}


def cut_points(df: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """For each column values at equal shares of the rows; a column of few values is cut at each but the last."""
    shares = [i / bins for i in range(1, bins)]
    out = []
    for c in names:
        few = [r[0] for r in df.select(number(c).alias("v")).distinct().limit(bins + 1).collect()]
        values = sorted(few)[:-1] if len(few) <= bins else sorted(set(ordered.quantiles(df, number(c), shares, "q").first()["q"]))
        out.append(np.array(values, float))
    return out


def _grow(rows: DataFrame, edges: list[np.ndarray], done: Model, depth: int, least: int, shrink: float, drawn=None, allowed=None) -> Tree:
    """One tree on the gradients of the model so far; a pass for each level.

    ``drawn``: weights of a batch's rows (a bootstrap); ``allowed``: columns that a node may be split by.
    """
    k, wide = len(edges), max((len(e) for e in edges), default=0) + 1
    tree = Tree()
    frontier = [0]

    def sums(z: np.ndarray) -> np.ndarray:
        x, y = z[:, :k], z[:, k]
        raw = done.raw(x) if not done.mean else np.zeros(len(x))
        chance = 1 / (1 + np.exp(-raw)) if done.logistic else raw
        g, h = y - chance, chance * (1 - chance) if done.logistic else np.ones(len(y))
        w = np.ones(len(y)) if drawn is None else drawn(z[:, -1], len(done.trees))
        place = np.full(len(tree.feature), -1)
        place[frontier] = np.arange(len(frontier))
        node = place[tree.leaves(x)]
        out = np.zeros((len(frontier), k, wide, 3))
        own = np.flatnonzero((node >= 0) & (w > 0))
        for j, e in enumerate(edges):
            b = np.searchsorted(e, x[own, j], side="left")
            flat = node[own] * wide + b
            for i, v in enumerate((w * g, w * h, w)):
                out[:, j, :, i] = np.bincount(flat, weights=v[own], minlength=len(frontier) * wide).reshape(-1, wide)
        return out

    for level in range(depth + 1):
        got = added(rows, sums, (len(frontier), k, wide, 3))
        following = []
        for i, node in enumerate(frontier):
            whole = got[i, 0].sum(axis=0)
            tree.value[node] = shrink * float(whole[0] / whole[1]) if whole[1] > 1e-12 else 0.0
            if level == depth:
                continue
            left = got[i].cumsum(axis=1)[:, :-1]
            right = whole - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - whole[0] ** 2 / whole[1]
            able = (left[..., 2] >= least) & (right[..., 2] >= least) & np.isfinite(gain)
            for j, e in enumerate(edges):
                able[j, len(e) :] = False
                if allowed is not None and not allowed(len(done.trees), node, j):
                    able[j] = False
            gain = np.where(able, gain, -np.inf)
            j, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[j, b] > 1e-9:
                following += tree.split(node, int(j), float(edges[j][b]), float(gain[j, b]))
        if not following:
            break
        frontier = following
    return tree


def _rows(df: DataFrame, y: str, names: list[str], key: str | None = None) -> DataFrame:
    own = complete(df, [*names, y])
    last = F.pmod(F.xxhash64(compat.col(key)), F.lit(1 << 52)).cast("double") if key else F.lit(0.0)
    return own.select(*[number(c).alias(f"x{i}") for i, c in enumerate(names)], number(y).alias("y"), last.alias("key"))


def decision_tree(df: DataFrame, y: str, x, depth: int = 4, least: int = 20, bins: int = BINS) -> Model:
    """A regression tree; of a column of 0 and 1, the leaves' values are shares."""
    names = compat.names(x)
    rows = _rows(df, y, names)
    model = Model(names, 0.0, [], mean=True)
    model.trees.append(_grow(rows, cut_points(complete(df, [*names, y]), names, bins), model, depth, least, 1.0))
    return model


def random_forest(df: DataFrame, y: str, x, key: str, trees: int = 20, depth: int = 6, least: int = 5, share: float = 0.6, bins: int = BINS, seed: int = 0) -> Model:
    """Trees on rows that weigh Poisson numbers and columns drawn for each node; ``key`` fixes a row's draws."""
    names = compat.names(x)
    rows, edges = _rows(df, y, names, key), cut_points(complete(df, [*names, y]), names, bins)
    limits = np.cumsum([np.exp(-1) / np.prod(range(1, i + 1)) for i in range(12)])

    def mixed(a: np.ndarray, b: int) -> np.ndarray:
        """A number from 0 to 1 for each key, by a mixing of bits."""
        v = a.astype(np.uint64) + np.uint64((b * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
        return (v >> np.uint64(11)) / float(1 << 53)

    model = Model(names, 0.0, [], mean=True)
    for _ in range(trees):
        drawn = lambda keys, t: np.searchsorted(limits, mixed(keys, t + 1), side="right").astype(float)
        allowed = lambda t, node, j: _chosen(seed, t, node, len(names), share)[j]
        model.trees.append(_grow(rows, edges, model, depth, least, 1.0, drawn, allowed))
    return model


def _chosen(seed: int, tree: int, node: int, k: int, share: float) -> np.ndarray:
    out = np.zeros(k, bool)
    out[np.random.default_rng([seed, tree, node]).permutation(k)[: max(1, round(share * k))]] = True
    return out


def gradient_boosting(df: DataFrame, y: str, x, trees: int = 20, depth: int = 3, step: float = 0.2, least: int = 20, bins: int = BINS, logistic: bool = False) -> Model:
    """Trees on what those before leave over: of the value, or of the log-odds of a column of 0 and 1."""
    names = compat.names(x)
    rows = _rows(df, y, names)
    mean = rows.agg(F.avg("y")).first()[0]
    if mean is None:
        raise ValueError("no complete rows")
    if logistic and not 0 < mean < 1:
        raise ValueError("both outcomes must occur")
    model = Model(names, float(np.log(mean / (1 - mean)) if logistic else mean), [], logistic)
    edges = cut_points(complete(df, [*names, y]), names, bins)
    for _ in range(trees):
        model.trees.append(_grow(rows, edges, model, depth, least, step))
    return model


def predicted(df: DataFrame, model: Model, name: str = "prediction") -> DataFrame:
    """``df`` with the model's value; null where a column is null or NaN."""
    share_package(df.sparkSession)

    @F.pandas_udf("double")
    def value(*columns):
        import pandas as pd

        x = np.column_stack([c.to_numpy(float) for c in columns])
        ok = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        out[ok] = model.predict(x[ok])
        return pd.Series(out)

    got = value(*[number(c) for c in model.names])
    return df.withColumn(name, F.when(F.isnan(got), None).otherwise(got))
