"""Steps on small frames with nulls, ties, empty input, zeros and negatives."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import compat
from sparkloom.operators import STEPS, apply_step, ordered
from sparkloom.plans.pipeline import catalogue, pipeline_hash, pipeline_view, run_pipeline


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, "a", 1.0, None), (2, "b", 2.5, "x"), (3, "a", None, "y"), (4, None, -3.0, "x"), (5, "b", 2.5, None), (6, "c", 0.0, "  p  q ")]
    return spark.createDataFrame(rows, "id int, g string, v double, t string")


def apply(df, op, **args):
    return apply_step(df, op, {k.rstrip("_"): v for k, v in args.items()})


def column(df, name, by="id"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_there_are_all_steps():
    assert len(STEPS) == 99 and set(catalogue()) == set(STEPS) and all(catalogue().values())


def test_missing_arguments_leave_the_input(frame):
    for op in STEPS:
        if op in ("distinct_rows", "remove_duplicates", "add_index_column", "quartiles"):
            continue
        assert apply_step(frame, op, {}).columns == frame.columns


def test_unknown_step(frame):
    with pytest.raises(ValueError):
        apply_step(frame, "no_such_step", {})
    with pytest.raises(ValueError):
        apply(frame, "select_columns", columns=['a"b'])


def test_shaping(frame):
    assert apply(frame, "move_column", column="v", position="first").columns == ["v", "id", "g", "t"]
    assert apply(frame, "move_column", column="id", position={"after": "nowhere"}).columns[-1] == "id"
    with pytest.raises(ValueError):
        apply(frame, "move_column", column="id", position="middle")
    assert apply(frame, "rename_columns", mapping={"v": "w"}, columns=["id", "v"]).columns == ["id", "w"]
    assert apply(frame, "rename_columns", mapping={"v": "w"}).columns == frame.columns
    assert apply(frame, "drop_columns", drop=["v"]).columns == ["id", "g", "t"]


def test_rows(frame):
    assert column(apply(frame, "sort_rows", sort=[{"column": "v", "direction": "desc"}, {"column": "id"}]).withColumn("n", F.monotonically_increasing_id()), "id", "n") == [2, 5, 1, 6, 4, 3]
    assert sorted(r.id for r in apply(frame, "remove_duplicates", by=["g"], order_by=[{"column": "id", "direction": "desc"}]).collect()) == [3, 4, 5, 6]
    assert apply(frame, "sample_rows", n=3).count() == 3 and apply(frame, "random_sample", n=2, seed=0.3).columns == frame.columns
    assert column(apply(frame, "add_index_column", order_by="id", start=10), "index") == [10, 11, 12, 13, 14, 15]
    assert sorted(column(apply(frame, "add_index_column", one_task_bytes=0), "index")) == [1, 2, 3, 4, 5, 6]


def test_filters(frame):
    assert column(apply(frame, "filter_rows", where="\"g\" = 'a' or v < 0"), "id") == [1, 3, 4]
    assert column(apply(frame, "filter_by_range", column="v", min=0), "id") == [1, 2, 5, 6]
    for bound in (None, 0):
        got = apply(frame, "filter_top_percent", column="v", percent=40, one_task_bytes=bound)
        assert column(got, "id") == [1, 2, 5] and column(got, "_pct_rank") == [0.4, 0.0, 0.0]


def test_computed(frame):
    c = apply(frame, "add_conditional_column", name="k", conditions=[{"when": "v > 1", "then": "hi"}, {"then": "no"}, {"when": "v < 0", "then": "lo"}], else_="mid")
    assert column(c, "k") == ["mid", "hi", "mid", "lo", "hi", "mid"]
    d = apply(frame, "add_math_column", name="q", operation="divide", columns=["id", "v"])
    assert column(d, "q")[:4] == [1.0, 0.8, None, -4 / 3] and column(d, "q")[5] == math.inf
    assert apply(frame, "add_math_column", name="q", operation="unknown", columns=["id", "v"]).columns == frame.columns
    assert column(apply(frame.withColumn("z", F.lit(0)), "add_math_column", name="m", operation="modulo", columns=["id", "z"]), "m") == [None] * 6


def test_cleaning(frame, spark):
    assert column(apply(frame, "drop_nulls", columns=["v", "t"]), "id") == [2, 4, 6]
    nan = spark.createDataFrame([(1, float("nan")), (2, None)], "id int, v double")
    assert apply(nan, "drop_nulls", columns=["v"]).count() == 1
    assert column(apply(frame, "fill_nulls", fills=[{"column": "v", "value": 9.0}]), "v")[2] == 9.0
    r = apply(frame, "replace_values", replacements=[{"column": "g", "old": "a", "new": "z"}, {"column": "g", "old": None, "new": "n"}])
    assert column(r, "g") == ["z", "b", "z", None, "b", "c"]
    halves = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 2.5), (4, -0.5)], "id int, v double")
    assert column(apply(halves, "change_type", conversions=[{"column": "v", "to_type": "INTEGER"}]), "v") == [0, 2, 2, 0]
    assert column(apply(frame, "clean_whitespace", columns=["t"]), "t")[5] == "p q"
    text = spark.createDataFrame([(1, "2.5"), (2, "1e3"), (3, "x"), (4, None), (5, "99999999999")], "id int, s string")
    assert column(apply(text, "data_type_check", column="s", target_type="INTEGER", name="ok"), "ok") == [True, True, False, False, False]


def test_text(frame):
    assert column(apply(frame, "text_merge", columns_in=["g", "t"], sep="-", name="m"), "m")[:3] == ["a-", "b-x", "a-y"]
    assert column(apply(frame, "text_split", column="t", sep=" ", parts=2), "t_part2")[1] == ""
    assert column(apply(frame, "text_contains", column="t", pattern="%"), "t_contains") == [None, True, True, True, None, True]
    assert column(apply(frame, "text_substring", column="t", start=-2), "t_sub")[5] == "q "
    with pytest.raises(ValueError):
        apply(frame, "text_pad", column="t", length=3, char="")


def test_dates(spark):
    rows = [(1, dt.datetime(2020, 12, 31, 23, 30), dt.datetime(2021, 1, 1, 0, 15)), (2, dt.datetime(2021, 3, 1), None), (3, dt.datetime(2024, 2, 29, 12), dt.datetime(2023, 2, 28))]
    df = spark.createDataFrame(rows, "id int, a timestamp_ntz, b timestamp_ntz")
    diff = lambda u: column(apply(df, "date_diff", start_column="a", end_column="b", unit=u), "date_diff")
    assert diff("year") == [1, None, -1] and diff("day") == [1, None, -366] and diff("hour") == [1, None, -8796]
    assert diff("month") == [1, None, -12] and diff("quarter") == [1, None, -4] and diff("minute")[0] == 45
    assert column(apply(df, "date_add", column="a", value=1, unit="year", ), "a_plus")[2] == dt.datetime(2025, 2, 28, 12)
    assert column(apply(df, "date_add", column="a", value=-90, unit="minute"), "a_plus")[0] == dt.datetime(2020, 12, 31, 22)
    assert column(apply(df, "date_part", column="a", part="dow"), "a_dow") == [4, 1, 4]
    assert column(apply(df, "date_part", column="a", part="epoch"), "a_epoch")[1] == 1614556800.0
    assert column(apply(df, "format_datetime", column="a", format="%d.%m.%Y %-H h"), "a_fmt")[0] == "31.12.2020 23 h"
    text = spark.createDataFrame([(1, "03/04/99 07:08"), (2, "bad")], "id int, s string")
    assert column(apply(text, "date_from_text", column="s", format="%d/%m/%y %H:%M", strict=False), "s") == [dt.datetime(1999, 4, 3, 7, 8), None]
    with pytest.raises(Exception):
        apply(text, "date_from_text", column="s", format="%d/%m/%y %H:%M").collect()
    with pytest.raises(ValueError):
        compat.unit("fortnight")


def test_whole_table_statistics(frame, spark):
    z = column(apply(frame, "z_score", column="v"), "v_zscore")
    assert z[2] is None and abs(sum(x for x in z if x is not None)) < 1e-9
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, v double")
    assert column(apply(same, "z_score", column="v"), "v_zscore") == [None, None]
    assert column(apply(same, "normalize", column="v"), "v_normalized") == [None, None]
    assert column(apply(same, "outlier_flag", column="v"), "v_is_outlier") == [False, False]
    assert column(apply(frame, "mode", column="g"), "g_mode") == ["a"] * 6
    assert column(apply(frame, "binning", column="v", bins=5), "v_bin") == [4, 6, None, 1, 6, 3]
    none = frame.limit(0)
    for op in ("z_score", "normalize", "percentile", "quartiles", "mode", "standard_deviation", "outlier_detection"):
        assert apply(none, op, column="v").count() == 0


@pytest.mark.parametrize("bound", [None, 0])
def test_ordered_steps_agree_with_and_without_blocks(frame, spark, bound, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 2)
    far = {"order_by": "id", "one_task_bytes": bound}
    assert column(apply(frame, "running_total", column="v", **far), "v_running_total") == [1.0, 3.5, 3.5, 0.5, 3.0, 3.0]
    assert column(apply(frame, "running_average", column="v", **far), "v_running_avg") == [1.0, 1.75, 1.75, 0.5 / 3, 0.75, 0.6]
    assert column(apply(frame, "running_min", column="v", **far), "v_running_min") == [1.0, 1.0, 1.0, -3.0, -3.0, -3.0]
    assert column(apply(frame, "lag_column", column="id", offset=2, default=0, **far), "id_lag2") == [0, 0, 1, 2, 3, 4]
    assert column(apply(frame, "lead_column", column="id", **far), "id_lead1") == [2, 3, 4, 5, 6, None]
    assert column(apply(frame, "rolling_sum", column="v", window=3, **far), "v_rolling_sum") == [1.0, 3.5, 3.5, -0.5, -0.5, -0.5]
    rank = lambda m: column(apply(frame, "rank_column", order_by="v", method=m, name="r", one_task_bytes=bound), "r")
    assert rank("rank") == [3, 1, 6, 5, 1, 4] and rank("dense_rank") == [2, 1, 5, 4, 1, 3]
    assert column(apply(frame, "percent_rank", order_by="v", direction="asc", one_task_bytes=bound), "v_pct_rank") == [0.4, 0.6, 1.0, 0.0, 0.6, 0.2]
    assert column(apply(frame, "binning", column="id", bins=4, method="equal_frequency", name="b", one_task_bytes=bound), "b") == [1, 1, 2, 2, 3, 4]
    assert column(apply(frame, "cumulative_product", column="v", **far), "v_cumprod")[4:] == pytest.approx([math.nan, math.nan], nan_ok=True)
    assert column(apply(frame, "quartiles", column="v", prefix="p", one_task_bytes=bound), "p_q1")[0] == 0.0
    assert column(apply(frame, "percentile", column="v", percentile=0.9, one_task_bytes=bound), "v_p90")[0] == pytest.approx(2.5)
    none = frame.limit(0)
    assert apply(none, "quartiles", column="v", one_task_bytes=bound).count() == 0
    assert apply(none, "running_total", column="v", **far).count() == 0
    assert apply(none, "rank_column", order_by="v", one_task_bytes=bound).count() == 0


def test_small_blocks_cross_their_edges(spark):
    df = spark.range(50).select("id", (F.col("id") * 7 % 11).alias("v"))
    key = [F.col("id").asc()]
    plain = column(ordered.trailing(df, key, 4, 0, lambda w: F.sum("v").over(w.rowsBetween(-4, 0)), "s"), "s")
    blocks = column(ordered.trailing(df, key, 4, 0, lambda w: F.sum("v").over(w.rowsBetween(-4, 0)), "s", one_task_bytes=0, block_rows=7), "s")
    assert plain == blocks
    both = [column(ordered.running(df, key, {"m": (F.max, F.col("v"), F.greatest)}, lambda p: p["m"], "m", one_task_bytes=b, block_rows=7), "m") for b in (None, 0)]
    assert both[0] == both[1]


def test_ema_does_not_run_out_of_precision(spark):
    df = spark.range(5000).select("id", F.lit(2.0).alias("v"))
    assert column(apply(df, "exponential_moving_average", column="v", order_by="id"), "v_ema") == pytest.approx([2.0] * 5000)


def test_windows_with_partitions(frame):
    assert column(apply(frame, "first_value", column="id", order_by="id", partition_by="g"), "id_first") == [1, 2, 1, 4, 2, 6]
    assert column(apply(frame, "last_value", column="id", order_by="v"), "id_last") == [3] * 6
    assert column(apply(frame, "nth_value", column="id", n=9, order_by="id"), "id_nth9") == [None] * 6


def test_aggregation(frame, spark):
    g = apply(frame, "group_aggregate", group_by=["g"], aggs=[{"fn": "list", "column": "t", "as": "l"}, {"fn": "count", "as": "n"}, {"fn": "product", "column": "id", "as": "p"}, {"fn": "x"}])
    rows = {r.g: r for r in g.collect()}
    assert rows["b"].n == 2 and set(rows["b"].l) == {None, "x"} and rows["a"].p == 3.0
    with pytest.raises(ValueError):
        apply(frame, "group_aggregate", group_by=["g"], aggs=[{"fn": "nonsense", "column": "v", "as": "x"}])
    assert {r.g: r.t_concat for r in apply(frame, "string_agg", column="t", group_by=["g"], order_by="id", separator="+").collect()}["b"] == "x"
    p = apply(frame, "pivot", index=["g"], pivot_col="t", value_col="id", agg_fn="count", values=["x", "y"])
    assert {(r.g, r.x, r.y) for r in p.collect()} == {("a", 0, 1), ("b", 1, 0), (None, 1, 0), ("c", 0, 0)}
    u = apply(frame.select("id", "g", "t"), "unpivot", id_cols=["id"], value_cols=["g", "t"])
    assert u.count() == 12 and u.filter("value is null").count() == 3
    other = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "g string, id int")
    j = STEPS["join"](frame, other, [{"left": "g", "right": "g"}], "left", ["id"], ["id"])
    assert sorted((r.id, r.right_id) for r in j.collect() if r.right_id) == [(1, 1), (1, 2), (3, 1), (3, 2)] and j.count() == 8
    with pytest.raises(ValueError):
        STEPS["join"](frame, other, [{"left": "g", "right": "g"}], "cross")
    mixed = STEPS["union_all"](frame.select("id"), frame.select("g"))
    assert mixed.count() == 12 and mixed.dtypes == [("id", "string")]


def test_quality(frame):
    assert column(apply(frame, "find_duplicates", columns=["v"]), "is_duplicate") == [False, True, False, False, True, False]
    assert column(apply(frame, "value_frequency", column="t"), "t_frequency") == [2, 2, 1, 2, 2, 1]
    assert column(apply(frame, "data_validation", validations=[{"condition": "v > 0"}]), "is_valid") == [True, True, False, False, True, False]
    assert column(apply(frame, "row_quality_score", columns=["g", "v", "t"]), "quality_score")[3] == pytest.approx(200 / 3)


def test_pipelines(frame):
    steps = [{"op": "filter_rows", "args": {"where": "v > 0"}}, {"op": "select_columns", "args": {"columns": ["id"]}}]
    assert column(run_pipeline(frame, steps), "id") == [1, 2, 5]
    assert pipeline_hash(steps) == pipeline_hash([{"args": {"where": "v > 0"}, "op": "filter_rows"}, steps[1]]) != pipeline_hash(steps[:1])
    view = pipeline_view(frame, steps, "some-id")
    assert frame.sparkSession.table(view).count() == 3 and view.startswith("ds_some_id_p_")


def test_filters_and_columns_reach_the_scan(spark):
    from tests.conftest import SF

    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = run_pipeline(df, [{"op": "filter_rows", "args": {"where": "l_quantity > 45"}}, {"op": "z_score", "args": {"column": "l_tax"}}, {"op": "select_columns", "args": {"columns": ["l_tax_zscore"]}}])
    text = plan._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,45.0)" in text and "SinglePartition" in text and "Window" not in text
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text
