"""Counted aggregates, partitions in blocks, smoothing and tails against plain Python."""

import math
import random
from collections import Counter, defaultdict
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.concepts import CONCEPTS, exponential_smoothing, left_to_others
from sparkloom.operators import counted, ordered, statistics, windows
from sparkloom.stats import analyses, ranks
from sparkloom.stats import distributions as D


def values(n=300):
    rng = random.Random(3)
    return [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 2.5, 7.0, rng.random()]), i) for i in range(n)] + [("none", None, -1)]


def share(v, p):
    k = (len(v) - 1) * p
    lo, hi = math.floor(k), math.ceil(k)
    return v[lo] + (k - lo) * (v[hi] - v[lo])


@pytest.mark.parametrize("bytes_", [None, 0])
def test_counted_aggregates(spark, monkeypatch, bytes_):
    if bytes_ is not None:
        monkeypatch.setattr(ordered, "ONE_TASK_BYTES", bytes_)
    rows = values()
    df = spark.createDataFrame(rows, "g string, v double, i int")
    names = ["median", "percentile_90", "mode", "mad", "nunique", "entropy", "count", "histogram"]
    found = {r.g: r for r in counted.grouped(df, ["g"], [(f, "v", f) for f in names]).collect()}
    groups = defaultdict(list)
    for g, v, _ in rows:
        groups[g] += [v] if v is not None else []
    assert found.keys() == groups.keys()
    for g, own in groups.items():
        own, r, c = sorted(own), found[g], Counter(own)
        assert r["nunique"] == len(c) and r["count"] == len(own)
        if not own:
            assert r["median"] is r["mode"] is r["mad"] is r["entropy"] is r["histogram"] is None
            continue
        m = median(own)
        assert math.isclose(r["median"], m) and math.isclose(r["percentile_90"], share(own, 0.9))
        assert r["mode"] == min(k for k in c if c[k] == max(c.values())) and math.isclose(r["mad"], median(abs(x - m) for x in own))
        assert math.isclose(r["entropy"], -sum(k / len(own) * math.log2(k / len(own)) for k in c.values())) and r["histogram"] == c
    whole = counted.grouped(df, [], [("median", "v", "m"), ("sum", "i", "s"), ("nunique", "g", "n")]).first()
    assert math.isclose(whole.m, median(v for _, v, _ in rows if v is not None)) and whole.n == 3
    assert counted.grouped(df.filter("i > 1000"), ["g"], [("median", "v", "m")]).count() == 0
    with pytest.raises(ValueError):
        counted.grouped(df, ["g"], [("percentile_101", "v", "p")])


@pytest.mark.parametrize("step,args", [
    (statistics.cumulative_sum, {"column": "v"}), (windows.running_min, {"column": "v"}), (windows.running_average, {"column": "v"}),
    (windows.lag_column, {"column": "v", "offset": 3}), (windows.lead_column, {"column": "v", "offset": 2, "default": -1.0}),
    (windows.first_value, {"column": "v"}), (windows.last_value, {"column": "v"}), (windows.nth_value, {"column": "v", "n": 40}),
    (statistics.rank_column, {"method": "rank"}), (statistics.rank_column, {"method": "dense_rank"}), (statistics.rank_column, {"method": "row_number"}),
])
def test_partitions_in_blocks_are_those_of_a_window(spark, monkeypatch, step, args):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 16)
    for fn in (ordered.running, ordered.trailing):
        monkeypatch.setitem(fn.__kwdefaults__, "block_rows", 16)
    df = spark.createDataFrame(values(), "g string, v double, i int")
    own = {**args, "order_by": [{"column": "v"}] if "rank" in args.get("method", "") else "i", "partition_by": "g", "name": "out"}
    near = lambda r: (r.g or "", r.i, r.v, r.out if not isinstance(r.out, float) else round(r.out, 9))
    whole, cut = (sorted(map(near, step(df, **own, one_task_bytes=b).collect()), key=str) for b in (1 << 40, 0))
    assert cut == whole


@pytest.mark.parametrize("block_rows", [7, 1 << 20])
def test_smoothing_by_blocks(spark, block_rows):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), t, rng.random() if rng.random() > 0.01 else None) for t in range(200)] + [(None, 1, 0.5), ("one", 1, 2.0), ("null", 1, None)]
    got = exponential_smoothing(spark.createDataFrame(rows, "g string, t int, v double"), "v", "t", ["g"], 0.25, block_rows=block_rows).collect()
    last, want = {}, {}
    for g, t, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if g in last:
            v = None if v is None or last[g] is None else 0.25 * v + 0.75 * last[g]
        last[g] = want[g, t] = v
    assert len(got) == len(rows)
    for r in got:
        w = want[r.g, r.t]
        assert r.smoothed is None if w is None else math.isclose(r.smoothed, w, rel_tol=1e-9)


def test_normal_tails_of_arrays():
    z = np.concatenate([np.linspace(-36, 36, 4001), [0.0]])
    want = np.array([D.normal_sf(t) for t in z])
    assert np.allclose(D.normal_sf_array(z), want, rtol=1e-11, atol=0)
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 999), [1e-200, 0.5]])
    assert np.allclose(D.normal_quantile_array(p), [D.normal_quantile(x) for x in p], rtol=1e-9, atol=1e-12)


def test_discordant_pairs_with_a_hot_value(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.randrange(20), 3 if rng.random() < 0.4 else rng.randrange(8)) for _ in range(250)]
    want = sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for i, a in enumerate(rows) for b in rows[:i])
    df = spark.createDataFrame(rows, "x int, y int").select(F.col("x").cast("double"), F.col("y").cast("double"))
    assert ranks.discordant_pairs(df, 16) == ranks.discordant_pairs(df) == want
    monkeypatch.setattr(ranks, "MOST_ROWS", 8)
    with pytest.raises(ValueError):
        ranks.discordant_pairs(df, 16)


def test_results_are_kept_to_a_bound(spark, monkeypatch):
    monkeypatch.setattr(analyses, "MOST_RESULTS", 2)
    analyses._cache.clear()
    df = spark.range(20).withColumn("v", F.col("id") * 1.5)
    for k in (1, 2, 1, 3):
        analyses.result(df, "ttest_1samp", {"column": "v", "popmean": k}, "f")
    assert [k.split('"popmean": ')[1][0] for k in analyses._cache] == ["1", "3"]


def test_concepts_that_nothing_computes():
    assert len(CONCEPTS) - len(left_to_others()) == 105 and "arima" in left_to_others() and "mode" not in left_to_others()
