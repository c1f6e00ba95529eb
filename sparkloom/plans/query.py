"""Declarative queries and operation payloads."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..functions.expr import BINARY
from ..operators import counted, ordered

MAX_ROWS = 10_000
#: The limit of a query that states none; a client's result is clamped anyway.
ALL_ROWS = (1 << 63) - 1


@dataclass
class Measure:
    name: str
    expr: str


@dataclass
class Filter:
    col: str
    op: str
    value: object = None


@dataclass
class OrderBy:
    col: str
    dir: str = "asc"

    def __post_init__(self):
        if self.dir.lower() not in ("asc", "desc"):
            raise ValueError(f"order is asc or desc, not {self.dir}")


def _all(kind, items) -> list:
    return [i if isinstance(i, kind) else kind(**i) for i in items or []]


@dataclass
class QuerySpec:
    """Columns, measures, filters, groups, order and limit; without a limit, all rows."""

    select: list[str] = field(default_factory=list)
    measures: list[Measure] = field(default_factory=list)
    groupby: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    order_by: list[OrderBy] = field(default_factory=list)
    limit: int | None = ALL_ROWS

    def __post_init__(self):
        self.measures, self.filters = _all(Measure, self.measures), _all(Filter, self.filters)
        self.order_by = _all(OrderBy, self.order_by)


def clamp(limit: int | None, most: int = MAX_ROWS) -> int:
    """The limit of a result that goes to a client."""
    return min(1000, most) if not limit or limit <= 0 else min(int(limit), most)


def predicate(f: Filter) -> Column:
    """The condition of a filter."""
    op, c = f.op.strip().upper(), compat.col(f.col)
    if op in ("IN", "NOT IN"):
        if not isinstance(f.value, (list, tuple)) or not f.value:
            raise ValueError(f"{op} takes a list that isn't empty")
        plain = [v for v in f.value if v is not None]
        found = c.isin(plain) if plain else F.lit(None).cast("boolean")
        found = found | F.lit(None).cast("boolean") if len(plain) < len(f.value) else found
        return ~found if op == "NOT IN" else found
    if op in ("IS", "IS NOT"):
        word = str(f.value).strip().upper()
        if f.value is None or word == "NULL":
            found = c.isNull()
        elif word in ("TRUE", "FALSE"):
            found = c.eqNullSafe(F.lit(word == "TRUE"))
        else:
            raise ValueError(f"{op} takes null, true or false")
        return ~found if op == "IS NOT" else found
    key = op.lower()
    if key not in ("=", "!=", "<", "<=", ">", ">=", "like", "ilike"):
        raise ValueError(f"unsupported filter: {f.op}")
    return BINARY[key](c, F.lit(f.value))


_ON_NUMBERS = re.compile(r'^\s*(AVG|SUM|MEDIAN|STDDEV\w*)\s*\(\s*"?([^"()+\-*/]+?)"?\s*\)\s*$', re.I)


def normalised(df: DataFrame, spec: QuerySpec) -> QuerySpec:
    """Numeric measures of other columns become dimensions.

    If no measure is left of those that were given, rows are counted as ``count_rows``.
    """
    numeric = set(compat.numeric_columns(df))
    measures, select, groupby = [], list(spec.select), list(spec.groupby)
    for m in spec.measures:
        found = _ON_NUMBERS.match(m.expr)
        if found and found[2] in df.columns and found[2] not in numeric:
            select += [found[2]] if found[2] not in select else []
            groupby += [found[2]] if found[2] not in groupby else []
        else:
            measures.append(m)
    if spec.measures and not measures:
        measures = [Measure("count_rows", "COUNT(*)")]
    return QuerySpec(select, measures, groupby, spec.filters, spec.order_by, spec.limit)


def run_query(df: DataFrame, spec: QuerySpec | dict, *, to_client: bool = False) -> DataFrame:
    """The query's result; with ``to_client`` the limit is clamped."""
    spec = normalised(df, spec if isinstance(spec, QuerySpec) else QuerySpec(**spec))
    rows = reduce(lambda d, f: d.filter(predicate(f)), spec.filters, df)
    measures = [compat.sql(m.expr).alias(m.name) for m in spec.measures]
    if spec.groupby or measures:
        extra = [c for c in spec.select if c not in spec.groupby]
        if extra:
            raise ValueError(f"selected but not grouped: {', '.join(extra)}")
        if measures:
            grouped = rows.groupBy(*compat.cols(spec.groupby)).agg(*measures)
        else:
            grouped = rows.select(*compat.cols(spec.groupby)).distinct()
        out = [*spec.select, *[m.name for m in spec.measures]]
    else:
        grouped, out = rows, spec.select or df.columns
    if spec.order_by:  # may name a group that isn't selected
        grouped = grouped.orderBy(*[compat.ordered(o.col, o.dir) for o in spec.order_by])
    limit = clamp(spec.limit) if to_client else spec.limit
    found = grouped.select(*compat.cols(out))
    return found if limit is None or limit >= ALL_ROWS else found.limit(limit)


# ---------------------------------------------------------------- operation payloads


def _metrics(metrics) -> list[tuple[str, str, str]]:
    """(function, column, name) of each metric."""
    out = []
    for m in metrics or []:
        fn, column = m.get("func") or m.get("fn"), m.get("col") or m.get("column") or "*"
        name = "count_rows" if fn == "count" and column == "*" else f"{fn}_{column}"
        out.append((fn, column, m.get("as") or m.get("alias") or name))
    return out


def _ordered(df: DataFrame, order_by, limit) -> DataFrame:
    keys = _all(OrderBy, order_by)
    return (df.orderBy(*[compat.ordered(o.col, o.dir) for o in keys]) if keys else df).limit(int(limit))


def _is_scan(df: DataFrame) -> bool:
    """Whether the rows come from files as they lie there, some left out at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation")


def _first(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows: of a table by its files' names and the places in them, else in the frame's own order.

    A plain limit takes those of the tasks that are done first, and Spark reads large
    files before small ones.  Each task keeps its first rows only, but reads all.
    """
    if _is_scan(rows):
        try:
            file = rows.metadataColumn("_metadata")
            return rows.orderBy(file["file_path"], file["file_block_start"], F.monotonically_increasing_id()).limit(limit)
        except AnalysisException:  # the relation has no files
            pass
    return rows.limit(limit)


def _aggregate(df: DataFrame, p: dict) -> DataFrame:
    rows = reduce(lambda d, f: d.filter(predicate(f)), _all(Filter, p.get("filters")), df)
    by, metrics = compat.names(p.get("group_by")), _metrics(p.get("metrics"))
    if metrics:
        rows = counted.grouped(rows, by, metrics)
    elif by:
        rows = rows.select(*compat.cols(by)).distinct()
    else:
        own = rows if p.get("order_by") else _first(rows, int(p.get("limit") or 1000))
        rows = own.select(*compat.cols(p["columns"])) if p.get("columns") else own
        if not p.get("order_by"):
            return rows
    return _ordered(rows, p.get("order_by"), p.get("limit") or 1000)


def _distinct(df: DataFrame, p: dict) -> DataFrame:
    if not p.get("columns"):
        raise ValueError("distinct takes columns")
    return _ordered(df.select(*compat.cols(p["columns"])).distinct(), p.get("order_by"), p.get("limit") or 1000)


def _crosstab(df: DataFrame, p: dict) -> DataFrame:
    by = compat.names(p.get("group_by"))
    if len(by) != 2:
        raise ValueError("crosstab takes two columns to group by")
    rows = reduce(lambda d, f: d.filter(predicate(f)), _all(Filter, p.get("filters")), df)
    counts = rows.groupBy(*compat.cols(by)).agg(F.count(F.lit(1)).alias("count"))
    return _ordered(counts, p.get("order_by"), p.get("limit") or MAX_ROWS)


def _long(df: DataFrame, columns: list[str], stats: dict) -> DataFrame:
    """One row for each column from one aggregate over all columns."""
    cells = [fn(compat.col(c).cast("double")).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, fn in stats.items()]
    row = df.agg(*cells)
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{k}").alias(k) for k in stats]) for i, c in enumerate(columns)]
    )
    return row.select(F.inline(rows))


def _columns(df: DataFrame, p: dict) -> list[str]:
    columns = compat.names(p.get("columns")) or compat.numeric_columns(df)
    if not columns:
        raise ValueError("there are no numeric columns")
    return columns


def _describe(df: DataFrame, p: dict) -> DataFrame:
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return _long(df, _columns(df, p), stats)


def _percentile(df: DataFrame, p: dict) -> DataFrame:
    share = float(p.get("p", 0.5))
    if not 0 < share < 1:
        raise ValueError("p lies between 0 and 1")
    found = [
        ordered.quantiles(df, compat.col(c), [share], "q").select(F.lit(c).alias("column"), F.col("q")[0].alias("percentile"))
        for c in _columns(df, p)
    ]
    return reduce(DataFrame.union, found)


OPERATIONS = {
    "aggregate": _aggregate,
    "filter": _aggregate,
    "distinct": _distinct,
    "crosstab": _crosstab,
    "describe": _describe,
    "percentile": _percentile,
}


def run_operation(df: DataFrame, operation: str, payload: dict | None = None) -> DataFrame:
    """One of the six operations."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {operation}")
    return OPERATIONS[operation](df, payload or {})
