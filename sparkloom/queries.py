"""A query for every operator of the engine, and independent DuckDB SQL for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compat
from .operators import aggregation
from .plans.pipeline import run_pipeline
from .plans.profile import profile_frame
from .plans.query import run_operation, run_query
from .stats import analyse
from .stats.analyses import trend_line
from .streaming import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents with their labels, which some don't have.
LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
SHIPPED = "(SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_orderdate, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    if name == "labelled":
        return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")
    if name == "shipped":
        both = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        return both.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "o_orderdate", "l_shipdate")
    return t(name)


def rounded(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show; None leaves exact ones alone."""
    if digits is None:
        return df
    return df.select(*[F.round(compat.col(c), digits).alias(c) if t in ("double", "float") else compat.col(c) for c, t in df.dtypes])


def add(name: str, source: str, steps: list | Callable, sql: str | None, digits: int | None = 6) -> None:
    """Register a pipeline (or a function of the source frame) and its SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _source(spark, sf_dir, source)
        out = steps(df) if callable(steps) else run_pipeline(df, [{"op": o, "args": a} for o, a in steps])
        return rounded(out, digits)

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLES[name] = " ".join(sql.format(labelled=LABELLED, shipped=SHIPPED).split())


def cols(*names: str):
    return ("select_columns", {"columns": list(names)})


# ------------------------------------------------------------------ flagship

FLAGSHIP = [
    ("filter_rows_safe", {"expr": {"op": "and", "args": [
        {"op": ">", "left": {"col": "l_quantity"}, "right": {"val": 25}},
        {"op": "between", "value": {"col": "l_discount"}, "low": {"val": 0.02}, "high": {"val": 0.08}}]}}),
    ("add_computed_safe", {"name": "revenue", "expr": {"op": "*", "left": {"col": "l_extendedprice"},
        "right": {"op": "-", "left": {"val": 1}, "right": {"col": "l_discount"}}}}),
    ("group_aggregate", {"group_by": ["l_returnflag", "l_linestatus"], "aggs": [
        {"fn": "count", "column": "*", "as": "n"}, {"fn": "sum", "column": "revenue", "as": "revenue"},
        {"fn": "avg", "column": "l_quantity", "as": "avg_quantity"}]}),
    ("sort_rows", {"sort": [{"column": "l_returnflag"}, {"column": "l_linestatus"}]}),
]
add("flagship", "lineitem", FLAGSHIP, """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
      round(avg(l_quantity), 2) AS avg_quantity
    FROM lineitem WHERE l_quantity > 25 AND l_discount BETWEEN 0.02 AND 0.08 GROUP BY ALL ORDER BY ALL""", 2)

# ------------------------------------------------------------------ shaping

add("select_columns", "customer", [cols("c_custkey", "c_mktsegment")], "SELECT c_custkey, c_mktsegment FROM customer")
add("drop_columns", "customer", [("drop_columns", {"keep": ["c_name", "c_acctbal"]})], "SELECT c_name, round(c_acctbal, 6) AS c_acctbal FROM customer")
add("rename_columns", "customer", [("rename_columns", {"mapping": {"c_acctbal": "balance"}, "columns": ["c_custkey", "c_acctbal"]})],
    "SELECT c_custkey, round(c_acctbal, 6) AS balance FROM customer")
add("reorder_columns", "nation", [("reorder_columns", {"columns": ["n_name", "n_nationkey"]})], "SELECT n_name, n_nationkey FROM nation")
add("add_constant_column", "nation", [("add_constant_column", {"name": "k", "value": "x"})], "SELECT *, 'x' AS k FROM nation")
add("duplicate_column", "nation", [("duplicate_column", {"source": "n_name", "name": "copy"})], "SELECT *, n_name AS copy FROM nation")
add("move_column", "nation", [("move_column", {"column": "n_regionkey", "position": {"after": "n_nationkey"}})],
    "SELECT n_nationkey, n_regionkey, n_name FROM nation")

# ------------------------------------------------------------------ rows

ORDER_SORT = {"sort": [{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}]}
ORDER_COLS = cols("o_orderkey", "o_totalprice")
add("sort_rows", "orders", [ORDER_COLS, ("sort_rows", ORDER_SORT)], "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
add("limit_rows", "orders", [ORDER_COLS, ("sort_rows", ORDER_SORT), ("limit_rows", {"n": 100})],
    "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 100")
add("offset_rows", "orders", [ORDER_COLS, ("sort_rows", ORDER_SORT), ("offset_rows", {"n": 14000})],
    "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey OFFSET 14000")
add("sample_rows", "orders", [cols("o_orderkey"), ("sample_rows", {"n": 50})], None)
add("random_sample", "orders", [cols("o_orderkey"), ("random_sample", {"n": 50, "seed": 0.5})], None)
add("distinct_rows", "lineitem", [("distinct_rows", {"columns": ["l_returnflag", "l_linestatus"]})], "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
add("remove_duplicates", "orders", [("remove_duplicates", {"by": ["o_custkey"], "order_by": [{"column": "o_orderdate"}, {"column": "o_orderkey"}]}), cols("o_custkey", "o_orderkey")],
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
for _name, _bound in (("add_index_column", None), ("add_index_column_at_scale", 0)):
    add(_name, "orders", [cols("o_orderkey"), ("add_index_column", {"name": "i", "start": 5, "order_by": "o_orderkey", "one_task_bytes": _bound})],
        "SELECT o_orderkey, 4 + row_number() OVER (ORDER BY o_orderkey) AS i FROM orders")
add("top_n", "orders", [("top_n", {"column": "o_totalprice", "n": 20}), ORDER_COLS],
    "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC LIMIT 20")
add("bottom_n", "orders", [("bottom_n", {"column": "o_totalprice", "n": 20}), ORDER_COLS],
    "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY orders.o_totalprice LIMIT 20")

# ------------------------------------------------------------------ filters

LINE_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
add("filter_rows", "lineitem", [("filter_rows", {"where": "\"l_quantity\" > 45 AND l_returnflag = 'R'"}), cols(*LINE_KEYS)],
    "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
add("filter_rows_safe", "lineitem", [("filter_rows_safe", {"allowed_columns": ["l_quantity", "l_returnflag", "l_linestatus", "l_discount"], "expr": {"op": "and", "args": [
    {"op": "between", "value": {"col": "l_quantity"}, "low": {"val": 10}, "high": {"val": 12}, "inclusive": False},
    {"op": "in", "left": {"col": "l_returnflag"}, "right": {"val": ["A", "R"]}},
    {"op": "like", "left": {"col": "l_linestatus"}, "right": {"val": "_"}},
    {"op": "not", "arg": {"op": "<", "left": {"col": "l_discount"}, "right": {"val": 0.05}}}]}}), cols(*LINE_KEYS)],
    """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity < 12
    AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE '_' AND NOT l_discount < 0.05""")
for _name, _bound in (("filter_top_percent", None), ("filter_top_percent_at_scale", 0)):
    add(_name, "orders", [("filter_top_percent", {"column": "o_totalprice", "percent": 5, "one_task_bytes": _bound}), cols("o_orderkey", "_pct_rank")],
        """SELECT o_orderkey, round(p, 6) AS _pct_rank FROM (SELECT o_orderkey, percent_rank() OVER (ORDER BY o_totalprice DESC) AS p FROM orders) WHERE p <= 0.05""")
add("filter_by_range", "orders", [("filter_by_range", {"column": "o_totalprice", "min": 1000, "max": 50000}), cols("o_orderkey")],
    "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")

# ------------------------------------------------------------------ computed

add("add_computed_column", "lineitem", [("add_computed_column", {"name": "revenue", "expr": "\"l_extendedprice\" * (1 - l_discount)"}), cols("l_orderkey", "l_partkey", "revenue")],
    "SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem", 4)
def _fn(name, *args):
    return {"op": "func", "name": name, "args": list(args)}


add("add_computed_safe", "customer", [
    ("add_computed_safe", {"name": "a", "expr": {"op": "/", "left": _fn("abs", {"col": "c_acctbal"}), "right": {"col": "c_nationkey"}}}),
    ("add_computed_safe", {"name": "b", "expr": _fn("concat", _fn("upper", {"col": "c_name"}), {"val": "-"}, _fn("lower", {"col": "c_mktsegment"}))}),
    ("add_computed_safe", {"name": "c", "expr": _fn("round", _fn("sqrt", _fn("abs", {"col": "c_acctbal"})), {"val": 2})}),
    ("add_computed_safe", {"name": "d", "expr": _fn("replace", _fn("trim", {"col": "c_name"}), {"val": "#"}, {"val": ""})}),
    ("add_computed_safe", {"name": "e", "expr": {"op": "%", "left": {"col": "c_custkey"}, "right": {"val": 7}}}),
    ("add_computed_safe", {"name": "f", "expr": {"op": "length", "args": [{"col": "c_name"}]}}),
    ("add_computed_safe", {"name": "g", "expr": _fn("log", {"col": "c_custkey"})}),
    ("add_computed_safe", {"name": "h", "expr": _fn("coalesce", {"val": None}, {"op": "-", "arg": {"col": "c_custkey"}})}),
    cols("c_custkey", "a", "b", "c", "d", "e", "f", "g", "h")],
    """SELECT c_custkey, round(CASE WHEN c_nationkey = 0 THEN 'inf'::DOUBLE ELSE abs(c_acctbal) / c_nationkey END, 6) AS a,
    upper(c_name) || '-' || lower(c_mktsegment) AS b, round(sqrt(abs(c_acctbal)), 2) AS c, replace(trim(c_name), '#', '') AS d,
    c_custkey % 7 AS e, length(c_name) AS f, round(CASE WHEN c_custkey > 0 THEN log10(c_custkey) END, 6) AS g, -c_custkey AS h FROM customer""")
add("expression_dates", "orders", [
    ("add_computed_safe", {"name": "m", "expr": _fn("strftime", {"col": "o_orderdate"}, {"val": "%Y-%m"})}),
    ("add_computed_safe", {"name": "q", "expr": _fn("date_trunc", {"val": "quarter"}, {"col": "o_orderdate"})}), cols("o_orderkey", "m", "q")],
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS m, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q FROM orders")
add("add_conditional_column", "lineitem", [("add_conditional_column", {"name": "size", "conditions": [{"when": "l_quantity >= 40", "then": "large"}, {"when": "l_quantity >= 20", "then": "medium"}], "else": "small"}),
    ("group_aggregate", {"group_by": ["size"], "aggs": [{"fn": "count", "as": "n"}]})],
    "SELECT CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'medium' ELSE 'small' END AS size, count(*) AS n FROM lineitem GROUP BY 1")
add("add_math_column", "part", [
    ("add_math_column", {"name": "plus", "operation": "add", "columns": ["p_retailprice", "p_size", "p_size"]}),
    ("add_math_column", {"name": "less", "operation": "subtract", "columns": ["p_retailprice", "p_size"]}),
    ("add_math_column", {"name": "times", "operation": "multiply", "columns": ["p_retailprice", "p_size"]}),
    ("add_math_column", {"name": "ratio", "operation": "divide", "columns": ["p_retailprice", "p_size"]}),
    ("add_math_column", {"name": "square", "operation": "power", "columns": ["p_size", "p_size"]}),
    ("add_computed_column", {"name": "square", "expr": "ln(square)"}),
    ("add_math_column", {"name": "rest", "operation": "modulo", "columns": ["p_partkey", "p_size"]}),
    cols("p_partkey", "plus", "less", "times", "ratio", "square", "rest")],
    """SELECT p_partkey, round(p_retailprice + p_size + p_size, 4) AS plus, round(p_retailprice - p_size, 4) AS less,
    round(p_retailprice * p_size, 4) AS times, round(p_retailprice / p_size, 4) AS ratio, round(ln(pow(p_size, p_size)), 4) AS square,
    p_partkey % p_size AS rest FROM part""", 4)

# ------------------------------------------------------------------ cleaning

add("drop_nulls", "labelled", [("drop_nulls", {"columns": ["quality", "toxic"]}), cols("doc_id", "quality")], "SELECT doc_id, quality FROM {labelled} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
add("fill_nulls", "labelled", [("fill_nulls", {"fills": [{"column": "quality", "value": -1}], "columns": ["doc_id", "quality", "toxic"]})], "SELECT doc_id, coalesce(quality, -1) AS quality, toxic FROM {labelled}")
add("replace_values", "labelled", [("replace_values", {"replacements": [{"column": "lang", "old": "en", "new": "english"}, {"column": "lang", "old": "de", "new": "german"}], "columns": ["doc_id", "lang"]})],
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS lang FROM {labelled}")
add("change_type", "orders", [("change_type", {"conversions": [{"column": "o_totalprice", "to_type": "INTEGER"}, {"column": "o_custkey", "to_type": "VARCHAR"}], "columns": ["o_orderkey", "o_totalprice", "o_custkey"]})],
    "SELECT o_orderkey, o_totalprice::INTEGER AS o_totalprice, o_custkey::VARCHAR AS o_custkey FROM orders")
add("coalesce", "labelled", [("coalesce", {"name": "first", "columns": ["quality", "toxic", "doc_id"]}), cols("doc_id", "first")], "SELECT doc_id, coalesce(quality, toxic, doc_id) AS first FROM {labelled}")
add("clean_whitespace", "part", [("add_computed_column", {"name": "p_name", "expr": "concat('  ', replace(p_name, ' ', '   '), ' ')"}), ("clean_whitespace", {"columns": ["p_name"], "all_columns": ["p_partkey", "p_name"]})],
    "SELECT p_partkey, trim(regexp_replace('  ' || replace(p_name, ' ', '   ') || ' ', '\\s+', ' ', 'g')) AS p_name FROM part")

# ------------------------------------------------------------------ text

_PART = ["p_partkey", "p_name"]
add("text_trim", "part", [("add_computed_column", {"name": "p_name", "expr": "concat('  ', p_name, ' ')"}), ("text_trim", {"columns": ["p_name"], "all_columns": _PART})], "SELECT p_partkey, trim('  ' || p_name || ' ') AS p_name FROM part")
add("text_lower", "part", [("text_lower", {"columns": ["p_type"], "all_columns": ["p_partkey", "p_type"]})], "SELECT p_partkey, lower(p_type) AS p_type FROM part")
add("text_upper", "part", [("text_upper", {"columns": ["p_name"], "all_columns": _PART})], "SELECT p_partkey, upper(p_name) AS p_name FROM part")
add("text_replace", "part", [("text_replace", {"replacements": [{"column": "p_name", "old": "e", "new": "3"}, {"column": "p_name", "old": "3", "new": "EE"}], "columns": _PART})],
    "SELECT p_partkey, replace(replace(p_name, 'e', '3'), '3', 'EE') AS p_name FROM part")
add("text_split", "customer", [("text_split", {"column": "c_name", "sep": "#", "parts": 3}), cols("c_custkey", "c_name_part1", "c_name_part2", "c_name_part3")],
    "SELECT c_custkey, split_part(c_name, '#', 1) AS c_name_part1, split_part(c_name, '#', 2) AS c_name_part2, split_part(c_name, '#', 3) AS c_name_part3 FROM customer")
add("text_merge", "labelled", [("text_merge", {"columns_in": ["lang", "quality", "source"], "sep": "|", "name": "m"}), cols("doc_id", "m")],
    "SELECT doc_id, coalesce(lang::VARCHAR, '') || '|' || coalesce(quality::VARCHAR, '') || '|' || coalesce(source::VARCHAR, '') AS m FROM {labelled}")
add("text_length", "part", [("text_length", {"column": "p_name"}), cols("p_partkey", "p_name_length")], "SELECT p_partkey, length(p_name) AS p_name_length FROM part")
add("text_substring", "part", [("text_substring", {"column": "p_name", "start": 2, "length": 4}), ("text_substring", {"column": "p_name", "start": 0, "length": 3, "name": "zero"}), cols("p_partkey", "p_name_sub", "zero")],
    "SELECT p_partkey, substring(p_name, 2, 4) AS p_name_sub, substring(p_name, 0, 3) AS zero FROM part")
add("text_pad", "customer", [("text_pad", {"column": "c_mktsegment", "length": 12, "char": "*"}), ("text_pad", {"column": "c_mktsegment", "length": 5, "side": "right", "name": "cut"}), cols("c_custkey", "c_mktsegment_padded", "cut")],
    "SELECT c_custkey, lpad(c_mktsegment, 12, '*') AS c_mktsegment_padded, rpad(c_mktsegment, 5, ' ') AS cut FROM customer")
add("text_contains", "part", [("text_contains", {"column": "p_name", "pattern": "a_e"}), cols("p_partkey", "p_name_contains")], "SELECT p_partkey, p_name LIKE '%a_e%' AS p_name_contains FROM part")
add("text_starts_with", "part", [("text_starts_with", {"column": "p_name", "prefix": "b"}), cols("p_partkey", "p_name_starts")], "SELECT p_partkey, starts_with(p_name, 'b') AS p_name_starts FROM part")
add("text_ends_with", "part", [("text_ends_with", {"column": "p_name", "suffix": "n"}), cols("p_partkey", "p_name_ends")], "SELECT p_partkey, suffix(p_name, 'n') AS p_name_ends FROM part")

# ------------------------------------------------------------------ dates

_DATE = "o_orderdate"
add("date_from_text", "orders", [("format_datetime", {"column": _DATE, "format": "%m/%d/%y %H:%M", "as": "t"}), ("date_from_text", {"column": "t", "format": "%m/%d/%y %H:%M"}), cols("o_orderkey", "t")],
    "SELECT o_orderkey, date_trunc('minute', o_orderdate)::TIMESTAMP AS t FROM orders")
_PARTS = ("year", "month", "day", "dow", "doy", "week", "quarter", "hour", "isodow", "epoch", "decade")
add("date_part", "orders", [*[("date_part", {"column": _DATE, "part": p}) for p in _PARTS], cols("o_orderkey", *[f"{_DATE}_{p}" for p in _PARTS])],
    "SELECT o_orderkey, " + ", ".join(f"date_part('{p}', o_orderdate) AS {_DATE}_{p}" for p in _PARTS) + " FROM orders")
_TRUNC = ("year", "quarter", "month", "week", "day", "hour")
add("date_trunc", "orders", [*[("date_trunc", {"column": _DATE, "unit": u}) for u in _TRUNC], cols("o_orderkey", *[f"{_DATE}_{u}" for u in _TRUNC])],
    "SELECT o_orderkey, " + ", ".join(f"date_trunc('{u}', o_orderdate)::TIMESTAMP AS {_DATE}_{u}" for u in _TRUNC) + " FROM orders")
_FMT = "%A %a, %d %B %b %Y %y %j %I %p %H:%M:%S %w %U %W %-d/%-m %%"
add("format_datetime", "orders", [("format_datetime", {"column": _DATE, "format": _FMT}), cols("o_orderkey", f"{_DATE}_fmt")], f"SELECT o_orderkey, strftime(o_orderdate, '{_FMT}') AS {_DATE}_fmt FROM orders")
_UNITS = ("day", "week", "month", "quarter", "year", "hour")
add("date_diff", "shipped", [*[("date_diff", {"start_column": _DATE, "end_column": "l_shipdate", "unit": u, "name": f"d_{u}"}) for u in _UNITS], cols("o_orderkey", "l_partkey", *[f"d_{u}" for u in _UNITS])],
    "SELECT o_orderkey, l_partkey, " + ", ".join(f"date_diff('{u}', o_orderdate, l_shipdate) AS d_{u}" for u in _UNITS) + " FROM {shipped}")
add("date_add", "orders", [("date_add", {"column": _DATE, "value": 7}), ("date_add", {"column": _DATE, "value": 1, "unit": "month", "name": "m"}), ("date_add", {"column": _DATE, "value": 36, "unit": "hours", "name": "h"}), cols("o_orderkey", f"{_DATE}_plus", "m", "h")],
    "SELECT o_orderkey, o_orderdate + INTERVAL 7 day AS o_orderdate_plus, o_orderdate + INTERVAL 1 month AS m, o_orderdate + INTERVAL 36 hour AS h FROM orders")
add("date_subtract", "orders", [("date_subtract", {"column": _DATE, "value": 2, "unit": "week"}), ("date_subtract", {"column": _DATE, "value": 1, "unit": "year", "name": "y"}), cols("o_orderkey", f"{_DATE}_minus", "y")],
    "SELECT o_orderkey, o_orderdate - INTERVAL 2 week AS o_orderdate_minus, o_orderdate - INTERVAL 1 year AS y FROM orders")
add("age_calculation", "orders", [("age_calculation", {"birthdate_column": _DATE, "reference_date": "DATE '2003-02-01'"}), cols("o_orderkey", "age")], "SELECT o_orderkey, date_diff('year', o_orderdate, TIMESTAMP '2003-02-01') AS age FROM orders")
add("quarter_from_date", "orders", [("quarter_from_date", {"column": _DATE}), cols("o_orderkey", f"{_DATE}_quarter")], "SELECT o_orderkey, quarter(o_orderdate) AS o_orderdate_quarter FROM orders")
add("week_of_year", "orders", [("week_of_year", {"column": _DATE}), cols("o_orderkey", f"{_DATE}_week")], "SELECT o_orderkey, week(o_orderdate) AS o_orderdate_week FROM orders")

# ------------------------------------------------------------------ statistics

_PRICE = "o_totalprice"
for _name, _bound in (("", None), ("_at_scale", 0)):
    add(f"percentile{_name}", "orders", [("percentile", {"column": _PRICE, "percentile": 0.9, "one_task_bytes": _bound}), cols("o_orderkey", f"{_PRICE}_p90")], "SELECT o_orderkey, round(quantile_cont(o_totalprice, 0.9) OVER (), 4) AS o_totalprice_p90 FROM orders", 4)
    add(f"quartiles{_name}", "orders", [("quartiles", {"column": _PRICE, "prefix": "p", "one_task_bytes": _bound}), cols("o_orderkey", "p_q1", "p_q2", "p_q3")],
        "SELECT o_orderkey, round(quantile_cont(o_totalprice, 0.25) OVER (), 4) AS p_q1, round(quantile_cont(o_totalprice, 0.5) OVER (), 4) AS p_q2, round(quantile_cont(o_totalprice, 0.75) OVER (), 4) AS p_q3 FROM orders", 4)
add("z_score", "orders", [("z_score", {"column": _PRICE}), cols("o_orderkey", f"{_PRICE}_zscore")], "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS o_totalprice_zscore FROM orders")
add("normalize", "orders", [("normalize", {"column": _PRICE}), cols("o_orderkey", f"{_PRICE}_normalized")],
    "SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS o_totalprice_normalized FROM orders")
add("standard_deviation", "customer", [("standard_deviation", {"column": "c_acctbal"}), ("standard_deviation", {"column": "c_acctbal", "population": True, "name": "pop"}), cols("c_custkey", "c_acctbal_std", "pop")],
    "SELECT c_custkey, round(stddev_samp(c_acctbal) OVER (), 4) AS c_acctbal_std, round(stddev_pop(c_acctbal) OVER (), 4) AS pop FROM customer", 4)
add("variance", "customer", [("variance", {"column": "c_acctbal"}), ("variance", {"column": "c_acctbal", "population": True, "name": "pop"}), cols("c_custkey", "c_acctbal_var", "pop")],
    "SELECT c_custkey, round(var_samp(c_acctbal) OVER (), 2) AS c_acctbal_var, round(var_pop(c_acctbal) OVER (), 2) AS pop FROM customer", 2)
add("correlation", "part", [("correlation", {"x_column": "p_size", "y_column": "p_retailprice", "name": "r"}), cols("p_partkey", "r")], "SELECT p_partkey, round(corr(p_size, p_retailprice) OVER (), 6) AS r FROM part")
add("covariance", "part", [("covariance", {"x_column": "p_size", "y_column": "p_retailprice", "name": "s"}), ("covariance", {"x_column": "p_size", "y_column": "p_retailprice", "population": True, "name": "p"}), cols("p_partkey", "s", "p")],
    "SELECT p_partkey, round(covar_samp(p_size, p_retailprice) OVER (), 4) AS s, round(covar_pop(p_size, p_retailprice) OVER (), 4) AS p FROM part", 4)
add("binning", "orders", [("binning", {"column": _PRICE}), cols("o_orderkey", f"{_PRICE}_bin")],
    """SELECT o_orderkey, CASE WHEN o_totalprice = hi THEN 6 ELSE floor((o_totalprice - lo) / ((hi - lo) / 5))::BIGINT + 1 END AS o_totalprice_bin
    FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
for _name, _bound in (("binning_equal_frequency", None), ("binning_equal_frequency_at_scale", 0)):
    add(_name, "orders", [("binning", {"column": "o_orderkey", "bins": 7, "method": "equal_frequency", "name": "b", "one_task_bytes": _bound}), cols("o_orderkey", "b")], "SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS b FROM orders")
add("outlier_detection", "orders", [("outlier_detection", {"column": _PRICE, "multiplier": 0.4}), cols("o_orderkey", "q1", "q3", f"{_PRICE}_is_outlier")],
    """SELECT o_orderkey, round(q1, 4) AS q1, round(q3, 4) AS q3, o_totalprice < q1 - 0.4 * (q3 - q1) OR o_totalprice > q3 + 0.4 * (q3 - q1) AS o_totalprice_is_outlier
    FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)""", 4)
_LAGS = range(1, 11)
_EMA = "(coalesce(value, 0) + %s) / (1 + %s)" % (
    " + ".join(f"coalesce(lag(value, {k}) OVER w, 0) * pow(0.7, -{k})" for k in _LAGS),
    " + ".join(f"CASE WHEN rn > {k} THEN pow(0.7, -{k}) ELSE 0 END" for k in _LAGS),
)
# over all events; the weights stand inside the frame and the factors are near 1, so that SQL stays stable at any length
for _name, _bound in (("", None), ("_whole", None), ("_at_scale", 0)):
    _far = {"order_by": "ts", "one_task_bytes": _bound}
    add(f"cumulative_product{_name}", "events", [("add_computed_column", {"name": "v", "expr": "1 + value / 100000000"}), ("cumulative_product", {"column": "v", **_far}), cols("event_id", "v_cumprod")],
        "SELECT event_id, round(exp(sum(ln(1 + value / 100000000)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)), 6) AS v_cumprod FROM events")
    add(f"exponential_moving_average{_name}", "events", [("exponential_moving_average", {"column": "value", **_far}), cols("event_id", "rn", "value_ema")],
        f"SELECT event_id, rn, round({_EMA}, 4) AS value_ema FROM (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM events) WINDOW w AS (ORDER BY rn)", 4)
for _name, _bound in (("", None), ("_at_scale", 0)):
    _far = {"order_by": "ts", "one_task_bytes": _bound}
    _w = "OVER (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    _r = "OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    add(f"moving_average{_name}", "events", [("moving_average", {"column": "value", "window": 7, **_far}), cols("event_id", "value_ma7")], f"SELECT event_id, round(avg(value) {_w}, 4) AS value_ma7 FROM events", 4)
    add(f"rolling_std_dev{_name}", "events", [("rolling_std_dev", {"column": "value", "window": 7, **_far}), cols("event_id", "value_rolling_std")], f"SELECT event_id, round(stddev_samp(value) {_w}, 4) AS value_rolling_std FROM events", 4)
    add(f"cumulative_sum{_name}", "events", [("cumulative_sum", {"column": "value", **_far}), cols("event_id", "value_cumsum")], f"SELECT event_id, round(sum(value) {_r}, 4) AS value_cumsum FROM events", 4)
    for _m in ("rank", "dense_rank", "row_number"):
        _key = "p_size" if _m != "row_number" else "p_partkey"
        add(f"rank_column_{_m}{_name}", "part", [("rank_column", {"order_by": _key, "method": _m, "name": "r", "one_task_bytes": _bound}), cols("p_partkey", "r")], f"SELECT p_partkey, {_m}() OVER (ORDER BY {_key} DESC) AS r FROM part")
    add(f"percent_rank{_name}", "part", [("percent_rank", {"order_by": "p_size", "one_task_bytes": _bound}), cols("p_partkey", "p_size_pct_rank")], "SELECT p_partkey, round(percent_rank() OVER (ORDER BY p_size DESC), 6) AS p_size_pct_rank FROM part")
    add(f"lag_column{_name}", "events", [("lag_column", {"column": "value", "offset": 2, "default": 0.0, **_far}), cols("event_id", "value_lag2")], "SELECT event_id, round(lag(value, 2, 0.0) OVER (ORDER BY ts), 6) AS value_lag2 FROM events")
    add(f"lead_column{_name}", "events", [("lead_column", {"column": "value", **_far}), cols("event_id", "value_lead1")], "SELECT event_id, round(lead(value, 1) OVER (ORDER BY ts), 6) AS value_lead1 FROM events")
    add(f"running_total{_name}", "events", [("running_total", {"column": "value", **_far}), cols("event_id", "value_running_total")], f"SELECT event_id, round(sum(value) {_r}, 4) AS value_running_total FROM events", 4)
    for _f, _label in (("min", "min"), ("max", "max")):
        _out = f"value_running_{_f}"
        add(f"running_{_label}{_name}", "events", [(f"running_{_label}", {"column": "value", **_far}), cols("event_id", _out)], f"SELECT event_id, round({_f}(value) {_r}, 7) AS {_out} FROM events", 7)
    add(f"running_average{_name}", "events", [("running_average", {"column": "user_id", **_far}), cols("event_id", "user_id_running_avg")], f"SELECT event_id, avg(user_id) {_r} AS user_id_running_avg FROM events", None)
    for _f in ("min", "max", "sum"):
        _out = f"value_rolling_{_f}"
        add(f"rolling_{_f}{_name}", "events", [(f"rolling_{_f}", {"column": "value", "window": 7, **_far}), cols("event_id", _out)], f"SELECT event_id, round({_f}(value) {_w}, 4) AS {_out} FROM events", 4)
add("rank_column_partitioned", "orders", [("rank_column", {"order_by": [{"column": "o_totalprice", "direction": "desc"}], "partition_by": "o_orderpriority", "name": "r"}), cols("o_orderkey", "r")],
    "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM orders")
add("cumulative_sum_partitioned", "events", [("cumulative_sum", {"column": "value", "order_by": "ts", "partition_by": "user_id"}), cols("event_id", "value_cumsum")],
    "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS value_cumsum FROM events", 4)
add("mode", "orders", [("mode", {"column": "o_orderpriority"}), cols("o_orderkey", "o_orderpriority_mode")],
    "SELECT o_orderkey, m AS o_orderpriority_mode FROM orders, (SELECT o_orderpriority AS m FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
add("simple_linear_regression", "part", [("simple_linear_regression", {"x_column": "p_size", "y_column": "p_retailprice"}), cols("p_partkey", "_slope", "_intercept", "p_retailprice_predicted")],
    """SELECT p_partkey, round(s, 4) AS _slope, round(i, 4) AS _intercept, round(s * p_size + i, 4) AS p_retailprice_predicted
    FROM part, (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part)""", 4)

# ------------------------------------------------------------------ windows with a partition

_PART = {"order_by": "ts", "partition_by": "event_type", "one_task_bytes": 0}
_WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
add("partitioned_windows_at_scale", "events", [
    ("cumulative_sum", {"column": "value", "name": "total", **_PART}), ("running_max", {"column": "value", "name": "top", **_PART}), ("running_average", {"column": "user_id", "name": "mean", **_PART}),
    ("lag_column", {"column": "value", "offset": 2, "name": "before", **_PART}), ("lead_column", {"column": "value", "name": "after", **_PART}),
    cols("event_id", "total", "top", "mean", "before", "after")],
    """SELECT event_id, round(sum(value) OVER r, 4) AS total, max(value) OVER r AS top, round(avg(user_id) OVER r, 4) AS mean, lag(value, 2) OVER w AS before, lead(value) OVER w AS after
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts), r AS (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING)""", 4)
add("partitioned_values_at_scale", "events", [
    ("first_value", {"column": "value", "name": "one", **_PART}), ("last_value", {"column": "value", "name": "end", **_PART}), ("nth_value", {"column": "value", "n": 3, "name": "third", **_PART}), cols("event_id", "one", "end", "third")],
    f"""SELECT event_id, first(value) OVER w AS one, last(value) OVER w AS "end", nth_value(value, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts {_WHOLE})""", None)
add("partitioned_ranks_at_scale", "lineitem", [
    *[("rank_column", {"order_by": [{"column": "l_quantity", "direction": "desc"}], "partition_by": "l_returnflag", "method": m, "name": m, "one_task_bytes": 0}) for m in ("rank", "dense_rank")],
    cols("l_orderkey", "l_linenumber", "rank", "dense_rank")],
    """SELECT l_orderkey, l_linenumber, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC)""")
for _f in ("first", "last"):
    add(f"{_f}_value", "events", [(f"{_f}_value", {"column": "value", "order_by": "ts", "partition_by": "user_id"}), (f"{_f}_value", {"column": "event_id", "order_by": "ts", "name": "all"}), cols("event_id", f"value_{_f}", "all")],
        f"""SELECT event_id, round({_f}(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS value_{_f},
        {_f}(event_id) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS "all" FROM events""")
add("nth_value", "events", [("nth_value", {"column": "value", "n": 3, "order_by": "ts", "partition_by": "user_id"}), ("nth_value", {"column": "event_id", "n": 5, "order_by": "ts", "name": "fifth"}), cols("event_id", "value_nth3", "fifth")],
    """SELECT event_id, round(nth_value(value, 3) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS value_nth3,
    nth_value(event_id, 5) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fifth FROM events""")

# ------------------------------------------------------------------ aggregation

_AGGS = [("count", "*", "n"), ("sum", "l_quantity", "s"), ("avg", "l_extendedprice", "a"), ("min", "l_discount", "lo"), ("max", "l_tax", "hi"), ("stddev", "l_quantity", "sd"), ("median", "l_quantity", "med"), ("var_pop", "l_quantity", "vp"), ("nunique", "l_suppkey", "nu"), ("percentile_90", "l_quantity", "p90"), ("skewness", "l_extendedprice", "sk"), ("kurtosis", "l_extendedprice", "ku")]
add("group_aggregate", "lineitem", [("group_aggregate", {"group_by": ["l_returnflag", "l_linestatus"], "aggs": [{"fn": f, "column": c, "as": a} for f, c, a in _AGGS]})],
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS s, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_tax) AS hi,
    round(stddev(l_quantity), 4) AS sd, median(l_quantity) AS med, round(var_pop(l_quantity), 4) AS vp, count(DISTINCT l_suppkey) AS nu,
    quantile_cont(l_quantity, 0.9) AS p90, round(skewness(l_extendedprice), 4) AS sk, round(kurtosis(l_extendedprice), 4) AS ku FROM lineitem GROUP BY 1, 2""", 4)
_MORE = [("mad", "l_quantity"), ("stddev_pop", "l_tax"), ("variance", "l_tax"), ("bit_and", "l_linenumber"), ("bit_or", "l_linenumber"), ("bit_xor", "l_partkey")]
add("group_aggregate_more", "lineitem", [("group_aggregate", {"group_by": ["l_returnflag"], "aggs": [{"fn": f, "column": c, "as": f} for f, c in _MORE]})],
    "SELECT l_returnflag, " + ", ".join(f"round({f}({c}), 6) AS {f}" if "bit" not in f else f"{f}({c}) AS {f}" for f, c in _MORE) + " FROM lineitem GROUP BY 1")
_ENTRIES = lambda df: df.withColumn("histogram", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ","))
add("group_aggregate_counted", "lineitem", lambda df: _ENTRIES(run_pipeline(df, [{"op": "group_aggregate", "args": {"group_by": ["l_returnflag"], "aggs": [
    {"fn": "entropy", "column": "l_quantity", "as": "entropy"}, {"fn": "histogram", "column": "l_linenumber", "as": "histogram"}, {"fn": "mode", "column": "l_tax", "as": "mode"},
    {"fn": "percentile_35", "column": "l_extendedprice", "as": "p35"}, {"fn": "median", "column": "l_extendedprice", "as": "med"}]}}])),
    """SELECT l_returnflag, round(entropy(l_quantity), 4) AS entropy, array_to_string(list_transform(map_entries(histogram(l_linenumber)), lambda e: e.key || ':' || e.value), ',') AS histogram,
    (SELECT l_tax FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, round(quantile_cont(l_extendedprice, 0.35), 4) AS p35, round(median(l_extendedprice), 4) AS med
    FROM lineitem o GROUP BY 1""", 4)
add("table_aggregate_counted", "lineitem", [("group_aggregate", {"aggs": [{"fn": "median", "column": "l_quantity", "as": "med"}, {"fn": "mad", "column": "l_quantity", "as": "mad"}, {"fn": "nunique", "column": "l_suppkey", "as": "n"}, {"fn": "count", "as": "rows"}]})],
    "SELECT median(l_quantity) AS med, mad(l_quantity) AS mad, count(DISTINCT l_suppkey) AS n, count(*) AS rows FROM lineitem")
add("weighted_average", "lineitem", [("weighted_average", {"value_column": "l_extendedprice", "weight_column": "l_quantity", "group_by": ["l_returnflag"]})],
    "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_avg FROM lineitem GROUP BY 1", 4)
add("count_distinct", "lineitem", [("count_distinct", {"column": "l_suppkey", "group_by": ["l_returnflag"]})], "SELECT l_returnflag, count(DISTINCT l_suppkey) AS l_suppkey_distinct_count FROM lineitem GROUP BY 1")
add("string_agg", "nation", [("string_agg", {"column": "n_name", "group_by": ["n_regionkey"], "order_by": "n_nationkey"})], "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS n_name_concat FROM nation GROUP BY 1")


def _two(name: str, other: str, fn: Callable[[DataFrame, DataFrame], DataFrame], first: str, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(table(spark, sf_dir, first), table(spark, sf_dir, other)))

    QUERIES[name], ORACLES[name] = query, " ".join(sql.split())


_ON = [{"left": "c_nationkey", "right": "n_nationkey"}]
_two("join_left", "nation", lambda c, n: aggregation.join(c, n.filter("n_regionkey < 3"), _ON, "left", ["c_custkey"], ["n_name"]), "customer",
     "SELECT c_custkey, n_name AS right_n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
_two("join_inner", "nation", lambda c, n: aggregation.join(c, n, _ON, "inner", ["c_custkey"], ["n_name", "n_regionkey"]), "customer",
     "SELECT c_custkey, n_name AS right_n_name, n_regionkey AS right_n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
_CUST = [{"left": "c_custkey", "right": "o_custkey"}]
for _name in ("join_right", "join_right_whole"):
    _two(_name, "orders", lambda c, o: aggregation.join(c.filter("c_mktsegment = 'BUILDING'"), o, _CUST, "right", ["c_custkey"], ["o_orderkey"]), "customer",
         "SELECT c_custkey, o_orderkey AS right_o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') RIGHT JOIN orders ON c_custkey = o_custkey")
for _name in ("join_full", "join_full_whole"):
    _two(_name, "orders", lambda c, o: aggregation.join(c.filter("c_acctbal > 0"), o.filter("o_orderpriority = '1-URGENT'"), _CUST, "full", ["c_custkey"], ["o_orderkey"]), "customer",
         "SELECT c_custkey, o_orderkey AS right_o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
_two("join_semi", "orders", lambda c, o: aggregation.join(c, o.filter("o_totalprice > 100000"), [{"left": "c_custkey", "right": "o_custkey"}], "semi", ["c_custkey"]), "customer",
     "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
_two("join_anti", "orders", lambda c, o: aggregation.join(c, o, [{"left": "c_custkey", "right": "o_custkey"}], "anti", ["c_custkey"]), "customer",
     "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_two("union_all", "nation", lambda a, b: aggregation.union_all(a.filter("n_regionkey <= 2"), b.filter("n_regionkey >= 2")), "nation",
     "SELECT * FROM nation WHERE n_regionkey <= 2 UNION ALL SELECT * FROM nation WHERE n_regionkey >= 2")
_two("union_distinct", "nation", lambda a, b: aggregation.union_all(a.filter("n_regionkey <= 2"), b.filter("n_regionkey >= 2"), True), "nation",
     "SELECT * FROM nation WHERE n_regionkey <= 2 UNION SELECT * FROM nation WHERE n_regionkey >= 2")
add("pivot", "lineitem", [("pivot", {"index": ["l_linestatus"], "pivot_col": "l_returnflag", "value_col": "l_quantity", "values": ["A", "N", "R"]})],
    """SELECT l_linestatus, sum(l_quantity) FILTER (l_returnflag = 'A') AS "A", sum(l_quantity) FILTER (l_returnflag = 'N') AS "N", sum(l_quantity) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
add("unpivot", "part", [("change_type", {"conversions": [{"column": "p_size", "to_type": "DOUBLE"}]}), ("unpivot", {"id_cols": ["p_partkey"], "value_cols": ["p_size", "p_retailprice"]})],
    "SELECT p_partkey, 'p_size' AS attribute, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")

# ------------------------------------------------------------------ data quality

add("data_validation", "labelled", [("data_validation", {"validations": [{"condition": "quality = 1"}, {"condition": "n_chars > 500"}]}), cols("doc_id", "is_valid")], "SELECT doc_id, coalesce(quality = 1 AND n_chars > 500, false) AS is_valid FROM {labelled}")
add("find_duplicates", "lineitem", [cols("l_orderkey", "l_linenumber"), ("find_duplicates", {"columns": ["l_orderkey", "l_linenumber"]})], "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_duplicate FROM lineitem")
add("value_frequency", "labelled", [("value_frequency", {"column": "quality"}), cols("doc_id", "quality_frequency")], "SELECT doc_id, count(*) OVER (PARTITION BY quality) AS quality_frequency FROM {labelled}")
add("outlier_flag", "orders", [("outlier_flag", {"column": _PRICE, "threshold": 1.5}), cols("o_orderkey", f"{_PRICE}_is_outlier")],
    "SELECT o_orderkey, abs((o_totalprice - m) / s) > 1.5 AS o_totalprice_is_outlier FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)")
add("missing_value_flag", "labelled", [("missing_value_flag", {"columns": ["lang", "quality"]}), cols("doc_id", "has_missing")], "SELECT doc_id, lang IS NULL OR quality IS NULL AS has_missing FROM {labelled}")
add("data_type_check", "customer", [("text_split", {"column": "c_name", "sep": "#"}), ("data_type_check", {"column": "c_name_part2", "target_type": "INTEGER", "name": "i"}), ("data_type_check", {"column": "c_name", "target_type": "DOUBLE", "name": "d"}), cols("c_custkey", "i", "d")],
    "SELECT c_custkey, try_cast(split_part(c_name, '#', 2) AS INTEGER) IS NOT NULL AS i, try_cast(c_name AS DOUBLE) IS NOT NULL AS d FROM customer")
add("row_quality_score", "labelled", [("row_quality_score", {"columns": ["lang", "quality", "toxic"]}), cols("doc_id", "quality_score")],
    "SELECT doc_id, round(((lang IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) * 100.0 / 3, 6)::DOUBLE AS quality_score FROM {labelled}")

# ------------------------------------------------------------------ queries, operations, profile, streams

add("query_spec", "lineitem", lambda df: run_query(df, {"select": ["l_returnflag"], "groupby": ["l_returnflag"], "measures": [{"name": "s", "expr": "SUM(l_quantity)"}, {"name": "a", "expr": "AVG(\"l_tax\")"}],
    "filters": [{"col": "l_linestatus", "op": "IN", "value": ["F", "O"]}, {"col": "l_quantity", "op": ">", "value": 5}, {"col": "l_returnflag", "op": "IS NOT", "value": None}], "order_by": [{"col": "s", "dir": "desc"}], "limit": 2}),
    "SELECT l_returnflag, sum(l_quantity) AS s, round(avg(l_tax), 6) AS a FROM lineitem WHERE l_linestatus IN ('F', 'O') AND l_quantity > 5 GROUP BY 1 ORDER BY s DESC LIMIT 2")
add("query_spec_measure_to_group", "orders", lambda df: run_query(df, {"measures": [{"name": "a", "expr": "AVG(o_orderpriority)"}]}), "SELECT o_orderpriority, count(*) AS count_rows FROM orders GROUP BY 1")
add("query_spec_projection", "customer", lambda df: run_query(df, {"select": ["c_custkey", "c_name"], "filters": [{"col": "c_name", "op": "ILIKE", "value": "%1%"}, {"col": "c_mktsegment", "op": "NOT IN", "value": ["BUILDING"]}]}),
    "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%1%' AND c_mktsegment NOT IN ('BUILDING')")
add("operation_aggregate", "lineitem", lambda df: run_operation(df, "aggregate", {"group_by": ["l_returnflag"], "metrics": [{"func": "count", "col": "*"}, {"func": "mean", "col": "l_quantity"}, {"func": "nunique", "col": "l_partkey"}, {"func": "percentile_75", "col": "l_quantity"}]}),
    "SELECT l_returnflag, count(*) AS count_rows, round(avg(l_quantity), 6) AS mean_l_quantity, count(DISTINCT l_partkey) AS nunique_l_partkey, quantile_cont(l_quantity, 0.75) AS percentile_75_l_quantity FROM lineitem GROUP BY 1")
add("operation_filter", "orders", lambda df: run_operation(df, "filter", {"columns": ["o_orderkey"], "filters": [{"col": "o_totalprice", "op": "<", "value": 3000}], "limit": 10000}), "SELECT o_orderkey FROM orders WHERE o_totalprice < 3000 LIMIT 10000")
add("operation_distinct", "orders", lambda df: run_operation(df, "distinct", {"columns": ["o_orderstatus", "o_orderpriority"]}), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("operation_crosstab", "lineitem", lambda df: run_operation(df, "crosstab", {"group_by": ["l_returnflag", "l_linestatus"]}), "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
add("operation_describe", "lineitem", lambda df: run_operation(df, "describe", {"columns": ["l_quantity", "l_discount"]}), " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max FROM lineitem" for c in ("l_quantity", "l_discount")), 4)
add("operation_percentile", "lineitem", lambda df: run_operation(df, "percentile", {"columns": ["l_quantity", "l_tax"], "p": 0.3}), " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.3), 6) AS percentile FROM lineitem" for c in ("l_quantity", "l_tax")))
add("profile", "labelled", lambda df: profile_frame(df).select("column", "role", "rows", "missing_pct", "count", "mean", "std", "min", "max"), " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{r}' AS role, count(*) AS rows, round((count(*) - count({c})) / count(*), 4) AS missing_pct, count({c}) AS count, "
    + (f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max" if r == "numeric" else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max")
    + " FROM {labelled}" for c, r in (("doc_id", "numeric"), ("lang", "categorical"), ("source", "categorical"), ("n_chars", "numeric"), ("quality", "numeric"), ("toxic", "numeric"))), 4)
add("windowed_counts", "events", lambda df: windowed(df, "ts", "1 hour", [{"fn": "count", "as": "n"}, {"fn": "sum", "column": "value", "as": "s"}], ["event_type"]),
    "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL", 4)

# ------------------------------------------------------------------ analyses


def _measures(name: str, params: dict, *keys: str):
    """The analysis in long form; with keys, the measures that SQL states too."""

    def run(df: DataFrame) -> DataFrame:
        found = analyse(df, name, params).select("measure", "value").filter("value is not null")
        return found.filter(F.col("measure").isin(list(keys))) if keys else found

    return run


def _long(select: str, *keys: str) -> str:
    """SQL of one row to (measure, value) rows."""
    return f"SELECT measure, round(value::DOUBLE, 4) AS value FROM (SELECT {', '.join(f'({k})::DOUBLE AS k{i}' for i, k in enumerate(keys))} FROM ({select})) , LATERAL (VALUES " + ", ".join(f"('{k}', k{i})" for i, k in enumerate(keys)) + ") v(measure, value)"


def _analysis(query: str, source: str, name: str, params: dict, select: str | None, *keys: str) -> None:
    add(f"analysis_{query}", source, _measures(name, params, *(keys if select else ())), _long(select, *keys) if select else None, 4)


_analysis("detailed_descriptives", "orders", "detailed_descriptives", {"column": _PRICE},
    "SELECT count(o_totalprice) AS count, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, quantile_cont(o_totalprice, .25) AS q1, median(o_totalprice) AS median, quantile_cont(o_totalprice, .75) AS q3, kurtosis_pop(o_totalprice) AS kurtosis FROM orders",
    "count", "mean", "std", "min", "max", "q1", "median", "q3", "kurtosis")
add("analysis_descriptives", "labelled", lambda df: analyse(df, "descriptives", {"columns": ["quality"]}).select(F.replace("measure", F.lit("quality."), F.lit("")).alias("measure"), "value"),
    _long("SELECT count(*) AS rows_total, count(quality) AS rows_used, count(*) - count(quality) AS rows_missing, avg(quality) AS mean, stddev_samp(quality) AS std, min(quality) AS min, quantile_cont(quality, .25) AS q1, median(quality) AS median, quantile_cont(quality, .75) AS q3, max(quality) AS max, quantile_cont(quality, .1) AS p10, quantile_cont(quality, .9) AS p90 FROM {labelled}",
          "rows_total", "rows_used", "rows_missing", "mean", "std", "min", "q1", "median", "q3", "max", "p10", "p90"), 4)
_analysis("correlation_pearson", "part", "correlation", {"x": "p_size", "y": "p_retailprice"}, "SELECT corr(p_size, p_retailprice) AS correlation, count(*) AS n FROM part", "correlation", "n")
_RANKED = "(SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part)"
_analysis("correlation_spearman", "part", "spearman-correlation", {"x": "p_size", "y": "p_retailprice"}, f"SELECT corr(a, b) AS correlation, count(*) AS n FROM {_RANKED}", "correlation", "n")
_analysis("correlation_kendall", "part", "correlation", {"x": "p_size", "y": "p_retailprice", "method": "kendall"},
    "SELECT sum(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice)) / sqrt(sum(abs(sign(a.p_size - b.p_size))) * sum(abs(sign(a.p_retailprice - b.p_retailprice)))) AS correlation FROM part a, part b WHERE a.p_partkey < b.p_partkey", "correlation")
add("analysis_correlation_matrix", "lineitem", lambda df: analyse(df, "correlation_matrix", {"columns": ["l_quantity", "l_extendedprice", "l_tax"]}).select("measure", "value").filter("measure in ('matrix.l_quantity.l_extendedprice', 'matrix.l_quantity.l_tax')"),
    "SELECT 'matrix.l_quantity.l_extendedprice' AS measure, round(corr(l_quantity, l_extendedprice), 4) AS value FROM lineitem UNION ALL SELECT 'matrix.l_quantity.l_tax', round(corr(l_quantity, l_tax), 4) FROM lineitem", 4)
_analysis("ttest_1samp", "orders", "ttest_1samp", {"column": _PRICE, "popmean": 1000}, "SELECT (avg(o_totalprice) - 1000) / (stddev_samp(o_totalprice) / sqrt(count(*))) AS t_statistic, avg(o_totalprice) AS mean, count(*) AS n FROM orders", "t_statistic", "mean", "n")
_analysis("ttest_2samp", "lineitem", "ttest", {"column1": "l_tax", "column2": "l_discount"}, "SELECT (avg(l_tax) - avg(l_discount)) / sqrt(var_samp(l_tax) / count(*) + var_samp(l_discount) / count(*)) AS t_statistic, avg(l_tax) AS mean1, avg(l_discount) AS mean2, count(*) AS n1 FROM lineitem", "t_statistic", "mean1", "mean2", "n1")
_analysis("paired_ttest", "lineitem", "paired_ttest", {"before": "l_tax", "after": "l_discount"}, "SELECT avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))) AS t_statistic, avg(l_discount - l_tax) AS mean_difference, count(*) AS n FROM lineitem", "t_statistic", "mean_difference", "n")
_analysis("anova", "customer", "anova", {"value": "c_acctbal", "group": "c_mktsegment"},
    """SELECT (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(v) / (sum(n) - count(*))) AS f_statistic, count(*) - 1 AS df_between, sum(n) - count(*) AS df_within
    FROM (SELECT count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS v FROM customer GROUP BY c_mktsegment), (SELECT avg(c_acctbal) AS g FROM customer)""", "f_statistic", "df_between", "df_within")
_analysis("chi_square_goodness", "part", "chi_square_goodness", {"observed": "p_size"}, "SELECT sum((p_size - e) * (p_size - e) / e) AS chi2_statistic, count(*) - 1 AS df FROM part, (SELECT avg(p_size) AS e FROM part)", "chi2_statistic", "df")
_CELLS = "(SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2)"
_analysis("chi_square_independence", "orders", "chi-square-test", {"column1": "o_orderstatus", "column2": "o_orderpriority"},
    """SELECT sum(power(coalesce(o, 0) - ra * rb / n, 2) / (ra * rb / n)) AS chi2_statistic, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df
    FROM (SELECT o_orderstatus AS a, count(*) AS ra FROM orders GROUP BY 1), (SELECT o_orderpriority AS b, count(*) AS rb FROM orders GROUP BY 1), (SELECT count(*) AS n FROM orders)
    LEFT JOIN (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS o FROM orders GROUP BY 1, 2) ON x = a AND y = b""", "chi2_statistic", "df")
_BOTH = "(SELECT l_tax AS v, 1 AS one FROM lineitem UNION ALL SELECT l_discount, 0 FROM lineitem)"
_analysis("mann_whitney", "lineitem", "mann_whitney", {"column1": "l_tax", "column2": "l_discount"},
    f"SELECT sum(r) FILTER (one = 1) - any_value(k) * (any_value(k) + 1) / 2 AS u_statistic FROM (SELECT one, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM {_BOTH}), (SELECT count(*) AS k FROM lineitem)", "u_statistic")
_analysis("wilcoxon", "lineitem", "wilcoxon_signed_rank", {"before": "l_tax", "after": "l_discount"},
    """SELECT least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS w_statistic, count(*) AS n FROM (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r
    FROM (SELECT l_tax - l_discount AS d FROM lineitem) WHERE d <> 0)""", "w_statistic", "n")
_analysis("kruskal_wallis", "customer", "kruskal_wallis", {"value": "c_nationkey", "group": "c_mktsegment"},
    """SELECT (12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / c) - 3 * (any_value(n) + 1)) / (1 - any_value(t) / (power(any_value(n), 3) - any_value(n))) AS h_statistic, count(*) - 1 AS df
    FROM (SELECT sum(r) AS s, count(*) AS c FROM (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2 AS r FROM customer) GROUP BY g),
    (SELECT count(*)::DOUBLE AS n FROM customer), (SELECT sum(power(k, 3) - k) AS t FROM (SELECT count(*)::DOUBLE AS k FROM customer GROUP BY c_nationkey))""", "h_statistic", "df")
_analysis("normality_test", "customer", "normality_test", {"column": "c_acctbal"}, None)
_analysis("regression_ols", "lineitem", "regression", {"y": "l_extendedprice", "x": ["l_quantity"]},
    """SELECT regr_r2(l_extendedprice, l_quantity) AS r_squared, count(*) AS n FROM lineitem""", "r_squared", "n")
add("analysis_regression_coefficients", "lineitem", _measures("regression", {"y": "l_extendedprice", "x": ["l_quantity"]}, "coefficients.const", "coefficients.l_quantity"),
    "SELECT 'coefficients.const' AS measure, round(regr_intercept(l_extendedprice, l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 'coefficients.l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem", 4)
add("analysis_logistic_regression", "lineitem", lambda df: _measures("logistic_regression", {"y": "y", "x": ["l_quantity", "l_discount"]})(df.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))), None, 4)
_EV = "(SELECT value, row_number() OVER (ORDER BY ts) - 1 AS i FROM events)"
add("analysis_moving_average", "events", lambda df: analyse(df, "moving_average", {"column": "value", "window": 7, "order_by": "ts"}),
    f"SELECT i, round(value, 4) AS value, round(CASE WHEN i >= 6 THEN avg(value) OVER (ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 4) AS moving_average FROM {_EV}", 4)
_analysis("trend", "events", "trend_analysis", {"column": "value", "time_col": "ts"}, f"SELECT regr_slope(value, i) * 1000 AS slope1000, regr_intercept(value, i) AS intercept, count(*) AS n FROM {_EV}", "intercept", "n")
add("analysis_trend_line", "events", lambda df: trend_line(df, "value", "ts").select("i", "trend"), f"SELECT i, round(s * i + c, 4) AS trend FROM {_EV}, (SELECT regr_slope(value, i) AS s, regr_intercept(value, i) AS c FROM {_EV})", 4)
for _m, _t, _where in (("zscore", 1.5, "abs((value - m) / s) > 1.5"), ("iqr", 0.2, "value < q1 - 0.2 * (q3 - q1) OR value > q3 + 0.2 * (q3 - q1)"), ("modified_z", 1.2, "abs(0.6745 * (value - md) / mad) > 1.2")):
    add(f"analysis_outliers_{_m}", "events", lambda df, m=_m, t=_t: analyse(df, "outlier_detection", {"column": "value", "method": m, "threshold": t}).select("event_id"),
        f"""SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, .25) AS q1, quantile_cont(value, .75) AS q3 FROM events),
        (SELECT median(value) AS md FROM events), (SELECT median(abs(value - (SELECT median(value) FROM events))) AS mad FROM events) WHERE {_where}""")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return QUERIES["flagship"](spark, sf_dir)
