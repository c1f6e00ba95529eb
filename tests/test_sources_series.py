"""The second Parquet scan, records, draws without copies of rows, and smoothing by chained lines."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom import concepts
from sparkloom.models.passes import uniform
from sparkloom.sources import io

TIME = dt.time(1, 2, 3)
COLUMNS = {
    "t32": (pa.array([TIME, None], pa.time32("ms")), "01:02:03"),
    "t64": (pa.array([TIME.replace(microsecond=250), None], pa.time64("us")), "01:02:03.000250"),
    "t64n": (pa.array([TIME, None], pa.time64("ns")), "01:02:03"),
    "nanos": (pa.array([1_700_000_000_123_456_789, None], pa.timestamp("ns", "UTC")), dt.datetime(2023, 11, 14, 22, 13, 20, 123456)),
    "half": (pa.array([np.float16(1.5), None], pa.float16()), 1.5),
    "nested": (pa.array([{"a": TIME, "b": 1}, None], pa.struct([("a", pa.time64("us")), ("b", pa.int64())])), json.dumps({"a": "01:02:03", "b": 1})),
    "listed": (pa.array([[TIME], None], pa.list_(pa.time64("ns"))), json.dumps(["01:02:03"])),
    "big": (pa.array([2**63 + 1, None], pa.uint64()), 2**63 + 1),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_types_that_spark_refuses_come_from_the_second_scan(spark, tmp_path, name):
    column, want = COLUMNS[name]
    pq.write_table(pa.table({name: column, "x": [1, 2]}), tmp_path / "a.parquet")
    got = io.read_parquet(spark, str(tmp_path)).orderBy("x").collect()
    assert got[0][name] == want and got[1][name] is None and [r.x for r in got] == [1, 2]


def test_the_second_scan_reads_folders_by_row_groups(spark, tmp_path):
    for k in range(3):
        t = pa.table({"at": pa.array([dt.time(k, i % 60) for i in range(1000)], pa.time64("us")), "i": range(1000), "more": [k] * 1000})
        pq.write_table(t if k else t.drop(["more"]), tmp_path / f"part-{k}.parquet", row_group_size=300)
    (tmp_path / "_SUCCESS").write_text("")
    df = io.read_parquet(spark, str(tmp_path))
    assert df.columns == ["at", "i"] and df.dtypes[0][1] == "string"
    assert df.count() == 3000 and df.select("at", "i").distinct().count() == 3000
    assert df.filter("at = '02:07:00'").agg(F.min("i")).first()[0] == 7
    assert io.Dataset(spark, str(tmp_path)).df.filter("i = 5").count() == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"PAR1 nothing")
    with pytest.raises(io.IngestError, match="second scan"):
        io.read_parquet(spark, str(tmp_path / "bad"))


def test_records_keep_nulls(spark):
    df = spark.createDataFrame([(1, None, dt.date(2020, 1, 2)), (2, "a", None)], "i int, s string, d date")
    assert sorted(io.records(df), key=lambda r: r["i"]) == [{"i": 1, "s": None, "d": "2020-01-02"}, {"i": 2, "s": "a", "d": None}]
    assert len(io.records(df, 1)) == 1 and io.json_records(df, None).count() == 2


def test_draws_look_even_and_repeat():
    u = uniform(np.arange(3000), 50, 7)
    assert u.shape == (3000, 50) and (uniform(np.arange(100, 200), 50, 7) == u[100:200]).all() and u.min() >= 0 and u.max() < 1
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002
    assert abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.07 and abs(np.corrcoef(u[:-1, 3], u[1:, 3])[0, 1]) < 0.07
    assert (uniform(np.arange(10), 50, 8) != u[:10]).all()


def test_bootstrap_and_permutation_without_copies(spark):
    rng = np.random.default_rng(5)
    x, g = rng.exponential(3, 4000), rng.random(4000) < 0.3
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x + g * 0.4, g)] + [(None, True), (1.0, None)], "x double, g boolean").repartition(3)
    got = concepts.bootstrap_mean(df, "x", 300)
    se = np.std(x + g * 0.4) / math.sqrt(4001)
    assert got["std_error"] == pytest.approx(se, rel=0.15) and got["high"] - got["low"] == pytest.approx(3.92 * se, rel=0.2)
    assert concepts.permutation_test(df, "x", "g", 200)["p_value"] < 0.05
    none = df.withColumn("x", F.rand(1)).repartition(3)
    assert concepts.permutation_test(none, "x", "g", 200)["p_value"] > 0.01
    with pytest.raises(ValueError):
        concepts.permutation_test(df.filter("g"), "x", "g")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_smoothing_equals_a_plain_loop(spark, block):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for s, n in (("a", 90), ("b", 1), ("c", 40), (None, 9)):
        x = [float(v) for v in rng.normal(size=n)]
        if s == "c":
            x[20] = None
        value = None
        for i, v in enumerate(x):
            v = math.nan if v is None else v
            value = v if i == 0 else 0.3 * v + 0.7 * value
            want[s, i] = value
            rows.append((s, i, None if math.isnan(v) else v))
    df = spark.createDataFrame(rows, "s string, i int, x double").repartition(3)
    got = {(r.s, r.i): r.smoothed for r in concepts.exponential_smoothing(df, "x", "i", ["s"], 0.3, block_rows=block).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if math.isnan(v) else got[k] == pytest.approx(v, abs=1e-12)


def test_statistics_judged_row_by_row(spark):
    df = spark.createDataFrame([(1.96, 10.0, 50), (None, None, None), (0.0, 0.0, 5)], "z double, s double, n int")
    p = [r.p_value for r in concepts.p_values(df, "z").collect()]
    assert p[0] == pytest.approx(0.05, abs=1e-4) and p[1] is None and p[2] == 1
    assert [r.p_value for r in concepts.p_values(df, "z", "t", "n").collect()][0] == pytest.approx(0.0556, abs=1e-3)
    assert [r.sample_size for r in concepts.sample_sizes(df, "s", 1.0).collect()] == [385, None, 0]
    assert [r.power for r in concepts.powers(df, "z", "n").collect()][0] == pytest.approx(1)
    assert [r.significant for r in concepts.significant(concepts.p_values(df, "z"), "p_value", 0.9).collect()] == [True, None, False]


def test_pair_plot_counts_all_rows(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [0.0, 1.0, 2.0, 4.0, None], "b": [1.0, 1.0, 3.0, 5.0, 9.0], "c": [7.0] * 5}))
    got = {(r.x, r.y, r.bin_x, r.bin_y): r["count"] for r in concepts.pair_plot(df, ["a", "b"], 2).collect()}
    assert got == {("b", "a", 1, 1): 2, ("b", "a", 1, 2): 1, ("b", "a", 2, 2): 1}


def test_csv_with_line_ends_in_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb, \"c\""), (2, "plain"), (3, None)], "i int, s string")
    source, target = str(tmp_path / "x.csv"), str(tmp_path / "out")
    assert io.export(df.coalesce(1), source, "csv") == 3
    assert io.ingest(spark, source, target, multi_line=True) == (3, 2)
    assert sorted(map(tuple, io.read_parquet(spark, target).collect())) == [(1, 'a\nb, "c"'), (2, "plain"), (3, None)]
