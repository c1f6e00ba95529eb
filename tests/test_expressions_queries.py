"""Expression trees, declarative queries, operations, profiles, sources and streams."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.expr import ExpressionError, compile_expr
from sparkloom.plans.profile import profile
from sparkloom.plans.query import QuerySpec, clamp, run_operation, run_query
from sparkloom.sources import Dataset, IngestError, export, ingest, records
from sparkloom.streaming import stream_pipeline, windowed
from tests.conftest import SF


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "B_c", None), (3, None, -2.0)], "id int, s string, v double")


def value(frame, tree, **options):
    return [r[0] for r in frame.orderBy("id").select(compile_expr(tree, **options)).collect()]


def test_values(frame):
    c, v = {"col": "v"}, {"col": "s"}
    assert value(frame, {"op": "/", "left": {"col": "id"}, "right": {"val": 0}}) == [math.inf] * 3
    assert value(frame, {"op": "concat", "args": [v, {"val": "!"}]}) == ["a!", "B_c!", "!"]
    assert value(frame, {"op": "func", "name": "log", "args": [{"val": 100}]}) == [2.0] * 3
    assert value(frame, {"op": "ilike", "left": v, "right": {"val": "b%"}}) == [False, True, None]
    assert value(frame, {"op": "in", "left": {"col": "id"}, "right": {"val": [1, None]}}) == [True, None, None]
    assert value(frame, {"op": "between", "value": {"col": "id"}, "low": {"val": 1}, "high": {"val": 3}, "inclusive": False}) == [False, True, False]
    assert value(frame, {"op": "or", "args": [{"op": ">", "left": c, "right": {"val": 0}}, {"op": "=", "left": {"col": "id"}, "right": {"val": 2}}]}) == [True, True, False]
    assert value(frame, {"op": "-", "arg": c}) == [-1.0, None, 2.0]
    assert value(frame, {"col": "id"}, allowed=[]) == [1, 2, 3]


@pytest.mark.parametrize(
    "tree",
    [
        {"col": 'x"y'}, {"col": "zzz"}, {}, [], {"op": "and", "args": [{"val": True}]}, {"op": "+", "left": {"val": 1}}, {"op": "nonsense"},
        {"op": "func", "name": "exec", "args": []}, {"op": "abs", "args": []}, {"op": "in", "left": {"col": "id"}, "right": {"col": "v"}},
        {"op": "strftime", "args": [{"col": "id"}, {"col": "s"}]}, {"val": [1]},
    ],
)
def test_errors(frame, tree):
    with pytest.raises(ExpressionError):
        compile_expr(tree, ["id", "v", "s", 'x"y'])


def test_query_spec(frame):
    rows = run_query(frame, {"select": ["s"], "groupby": ["s"], "measures": [{"name": "m", "expr": "AVG(s)"}]}).collect()
    assert {(r.s, r.count_rows) for r in rows} == {("a", 1), ("B_c", 1), (None, 1)}
    assert run_query(frame, QuerySpec(select=["id"], order_by=[{"col": "v", "dir": "desc"}], limit=2)).collect()[0].id == 1
    assert run_query(frame, {"filters": [{"col": "v", "op": "=", "value": None}]}).count() == 0
    assert run_query(frame, {"filters": [{"col": "v", "op": "IS", "value": None}]}).count() == 1
    for bad in ({"filters": [{"col": "v", "op": "~", "value": 1}]}, {"filters": [{"col": "v", "op": "IN", "value": []}]}, {"filters": [{"col": "v", "op": "IS", "value": "x"}]}, {"order_by": [{"col": "v", "dir": "up"}]}, {"select": ["v"], "measures": [{"name": "n", "expr": "COUNT(*)"}]}):
        with pytest.raises(ValueError):
            run_query(frame, bad)
    assert [clamp(n) for n in (None, 0, 5, 10**9)] == [1000, 1000, 5, 10_000]


def test_a_filter_with_a_limit_takes_the_tables_first_rows(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "t.parquet").mkdir()
    for name, low, high in (("a", 0, 30), ("b", 30, 60_000), ("c", 60_000, 60_100)):  # Spark reads the large file first
        pq.write_table(pa.table({"id": list(range(low, high)), "__file": ["x"] * (high - low)}), tmp_path / "t.parquet" / f"{name}.parquet", row_group_size=7000)
    table = spark.read.parquet(str(tmp_path / "t.parquet"))
    odd = [{"col": "id", "op": "!=", "value": 3}]
    for n in (10, 1000, 20_000, 70_000):
        got = run_operation(table, "filter", {"columns": ["id"], "filters": odd, "limit": n}).withColumn("id", F.col("id") + 0)
        assert sorted(r.id for r in got.collect()) == [i for i in range(60_100) if i != 3][:n]
    assert run_operation(table, "filter").columns == ["id", "__file"] and run_operation(table, "filter").agg(F.max("id")).collect()[0][0] == 999
    assert [r.id for r in run_operation(table.orderBy(F.desc("id")), "filter", {"columns": ["id"], "limit": 2}).collect()] == [60_099, 60_098]
    assert [r.id for r in run_operation(table, "filter", {"columns": ["id"], "order_by": [{"col": "id", "dir": "desc"}], "limit": 1}).collect()] == [60_099]
    assert run_operation(spark.range(9), "filter", {"limit": 5}).count() == 5 and run_operation(table.limit(0), "filter").count() == 0


def test_a_query_without_a_limit_gives_all_rows(spark):
    rows = spark.range(100_050)
    assert run_query(rows, {"select": ["id"]}).count() == run_query(rows, {"groupby": ["id"], "select": ["id"], "limit": None}).count() == 100_050
    assert run_query(rows, {"measures": [{"name": "n", "expr": "COUNT(*)"}], "groupby": ["id"]}).count() == 100_050
    assert run_query(rows, {"select": ["id"], "limit": 100_001}).count() == 100_001
    assert run_query(rows, {"select": ["id"]}, to_client=True).count() == 10_000 and run_query(rows, {"limit": 0}, to_client=True).count() == 1000


def test_operations(frame):
    assert run_operation(frame, "describe").count() == 2
    for op, payload in (("distinct", {}), ("crosstab", {"group_by": ["s"]}), ("percentile", {"p": 1}), ("nonsense", {})):
        with pytest.raises(ValueError):
            run_operation(frame, op, payload)
    with pytest.raises(ValueError):
        run_operation(frame.select("s"), "describe")


def test_profile(frame):
    p = profile(frame)
    assert p["n_rows"] == 3 and p["missing_pct"]["v"] == 0.3333 and p["numeric_summary"]["v"]["mean"] == -0.5
    assert [s["role"] for s in p["schema"]] == ["numeric", "categorical", "numeric"] and len(p["sample_rows"]) == 3
    assert profile(frame.limit(0))["missing_pct"] == {"id": 0.0, "s": 0.0, "v": 0.0}


def test_sources(spark, frame, tmp_path):
    assert export(frame, f"{tmp_path}/x.csv", "csv") == 3
    assert ingest(spark, f"{tmp_path}/x.csv", f"{tmp_path}/y.parquet") == (3, 3)
    data = Dataset(spark, f"{tmp_path}/y.parquet", "some-name")
    assert sorted(r.id for r in data.df.collect()) == [1, 2, 3] and data.fingerprint == Dataset(spark, f"{tmp_path}/y.parquet").fingerprint
    assert spark.table(data.view()).count() == 3
    assert ingest(spark, f"{tmp_path}/y.parquet", f"{tmp_path}/z.parquet") == (3, 3)
    assert len(records(data.df, 2)) == 2
    for bad in (lambda: ingest(spark, "x.txt", "y"), lambda: ingest(spark, f"{tmp_path}/none.parquet", "y")):
        with pytest.raises(IngestError):
            bad()
    with pytest.raises(ValueError):
        export(frame, f"{tmp_path}/w", "orc")


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    steps = [{"op": "filter_rows", "args": {"where": "value > 10"}}, {"op": "text_upper", "args": {"columns": ["event_type"]}}]
    with pytest.raises(ValueError):
        stream_pipeline(stream, [{"op": "z_score", "args": {"column": "value"}}])
    aggs = [{"fn": "count", "as": "n"}, {"fn": "max", "column": "value", "as": "hi"}]
    query = windowed(stream_pipeline(stream, steps), "ts", "1 day", aggs, late="3650 days").writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    want = windowed(stream_pipeline(events, steps), "ts", "1 day", aggs)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))
    assert want.agg(F.sum("n")).first()[0] == events.filter("value > 10").count()
