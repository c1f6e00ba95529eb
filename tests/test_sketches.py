"""Sketches against exact values, and merged ones against those of all rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aggregation
from sparkloom.operators import sketches as S

SCHEMA = "g string, day int, x double"


def rows(n=4000, seed=1):
    r = random.Random(seed)
    draw = [lambda: r.lognormvariate(0, 4), lambda: -r.lognormvariate(3, 2), lambda: 0.0, lambda: float(r.randint(-5, 5)), lambda: None, lambda: math.nan]
    out = [(r.choice(["a", "a", "a", "b", None]), r.randrange(9), r.choice(draw)()) for _ in range(n)]
    return out + [("inf", 1, math.inf), ("inf", 2, -math.inf), ("inf", 2, 1.0), ("none", 1, None), ("none", 2, math.nan)]


@pytest.mark.parametrize("accuracy", [0.01, 0.1])
def test_quantiles_are_within_the_accuracy_and_merges_equal_the_whole(spark, accuracy):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    whole = S.quantile_sketch(df, "x", ["g"], accuracy=accuracy)
    days = S.quantile_sketch(df, "x", ["g", "day"], accuracy=accuracy)
    merged = S.merge_quantile_sketches(days, ["g"])
    assert {r.g: bytes(r.sketch) for r in merged.collect()} == {r.g: bytes(r.sketch) for r in whole.collect()}
    shares = [0.0, 0.003, 0.3, 0.5, 0.77, 1.0]
    got = whole.select("g", *[S.quantile_estimate("sketch", p, accuracy=accuracy).alias(str(p)) for p in shares]).collect()
    assert {r.g for r in got} == {"a", "b", None, "inf"}
    for r in got:
        own = sorted(x for g, _, x in data if g == r.g and x is not None and not math.isnan(x))
        for p in shares:
            exact = own[math.floor(p * (len(own) - 1))]
            assert r[str(p)] == exact if math.isinf(exact) else abs(r[str(p)] - exact) <= accuracy * abs(exact) * (1 + 1e-9)


def test_distinct_values(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("day"), (F.col("id") % 20_001).cast("string").alias("v"))
    df = df.unionByName(spark.createDataFrame([(9, 1, "one"), (9, 2, "one"), (8, 1, None)], "g long, day long, v string"))
    whole, merged = S.distinct_sketch(df, "v", ["g"]), S.merge_distinct_sketches(S.distinct_sketch(df, "v", ["g", "day"]), ["g"])
    assert {r.g: bytes(r.sketch) for r in merged.collect()} == {r.g: bytes(r.sketch) for r in whole.collect()}
    got = {r.g: r.n for r in whole.select("g", S.distinct_estimate("sketch").alias("n")).collect()}
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.count_distinct("v").alias("n")).filter("n > 0").collect()}
    assert got.keys() == exact.keys() and got[9] == 1
    assert all(abs(got[g] - exact[g]) <= 0.06 * exact[g] for g in exact)
    total = S.merge_distinct_sketches(whole).select(S.distinct_estimate("sketch")).first()[0]
    assert abs(total - 20_002) < 0.06 * 20_002


def test_frequent_values_are_within_their_bounds(spark):
    r = random.Random(5)
    data = [(r.choice(["a", None]), r.randrange(5), f"v{int(r.paretovariate(0.7))}") for _ in range(6000)] + [("n", 0, None)]
    df = spark.createDataFrame(data, "g string, day int, v string").repartition(4)
    for sketch in (S.top_sketch(df, "v", ["g"], counters=20), S.merge_top_sketches(S.top_sketch(df, "v", ["g", "day"], counters=20), ["g"], counters=20)):
        for row in sketch.select("g", S.top_estimate("sketch", 20).alias("top"), S.top_error("sketch").alias("error")).collect():
            exact = Counter(v for g, _, v in data if g == row.g and v is not None)
            assert row.error <= sum(exact.values()) / 21
            assert all(e.low <= exact[e.value] <= e.high == e.low + row.error for e in row.top)
            found = {e.value for e in row.top}
            assert all(n <= row.error for v, n in exact.items() if v not in found)
            assert [e.low for e in row.top] == sorted((e.low for e in row.top), reverse=True)


def test_sketches_of_nothing_and_by_name(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.quantile_sketch(empty, "x", ["g"]).count() == 0
    one = S.quantile_sketch(empty, "x").select(S.quantile_estimate("sketch", 0.5).alias("q")).first()
    assert one.q is None and S.distinct_sketch(empty, "x").select(S.distinct_estimate("sketch")).first()[0] == 0
    assert S.top_sketch(empty, "g").select(S.top_estimate("sketch", 3)).first()[0] == []
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 5.0), ("a", 2, 7.0), (None, 1, -3.0), ("z", 1, None)], SCHEMA)
    aggs = [{"fn": f, "column": "x", "as": f} for f in ("approx_percentile_50", "approx_top_1", "approx_nunique", "sum", "median")]
    got = {r.g: r for r in aggregation.group_aggregate(df, ["g"], aggs).collect()}
    assert abs(got["a"].approx_percentile_50 - 5) < 0.05 and got["a"].approx_top_1 == ["5.0"] and got["a"].approx_nunique == 2 and got["a"].sum == 17
    assert abs(got[None].approx_percentile_50 + 3) < 0.03 and got["z"].approx_percentile_50 is None and got["z"].median is None
    whole = aggregation.group_aggregate(df, [], aggs[:3]).first()
    assert whole.approx_nunique == 3 and whole.approx_top_1 == ["5.0"]
    with pytest.raises(ValueError):
        aggregation.group_aggregate(df, [], [{"fn": "approx_percentile_101", "column": "x", "as": "x"}])
