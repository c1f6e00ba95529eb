"""Queries for sketches that are kept by day and merged later, with SQL that follows the same rules or states the bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ordered
from .operators import sketches as S
from .plans.pipeline import run_pipeline
from .queries import ORACLES, QUERIES, rounded, table

_SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each flag's net prices from the sketches of its days; ``same``: as the sketch of all rows."""
    rows = table(spark, sf_dir, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")) - 30000)
    days = S.quantile_sketch(rows, "net", ["l_returnflag", "l_shipdate"])
    merged = S.merge_quantile_sketches(days, ["l_returnflag"])
    whole = S.quantile_sketch(rows, "net", ["l_returnflag"], name="whole")
    both = merged.join(whole, "l_returnflag")
    shares = F.explode(F.array(*[F.struct(F.lit(p).alias("share"), S.quantile_estimate("sketch", p).alias("estimate")) for p in _SHARES]))
    return rounded(both.select("l_returnflag", (F.col("sketch") == F.col("whole")).alias("same"), shares.alias("e")).select("l_returnflag", "same", "e.share", "e.estimate"), 4)


_RANKED = """SELECT l_returnflag, net, row_number() OVER (PARTITION BY l_returnflag ORDER BY net) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n
    FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) - 30000 AS net FROM lineitem)"""
QUERIES["sketch_quantiles"] = sketch_quantiles
ORACLES["sketch_quantiles"] = f"""WITH s AS (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in _SHARES)}]) AS share), r AS ({_RANKED})
    SELECT l_returnflag, TRUE AS same, share, round(sign(net) * power(1.01 / 0.99, ceil(ln(abs(net)) / ln(1.01 / 0.99))) * 2 / (1.01 / 0.99 + 1), 4) AS estimate
    FROM r, s WHERE i = floor(share * (n - 1))"""


def sketch_quantile_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's estimates and whether they lie within the bound of the exact values."""
    rows = table(spark, sf_dir, "events")
    own = S.quantile_sketch(rows, "value", ["event_type"], accuracy=0.005)
    shares = F.explode(F.array(*[F.struct(F.lit(p).alias("share"), S.quantile_estimate("sketch", p, accuracy=0.005).alias("estimate")) for p in _SHARES]))
    found = own.select("event_type", shares.alias("e")).select("event_type", "e.*")
    return found.join(_exact(rows), ["event_type", "share"]).select("event_type", "share", F.round("exact", 6).alias("exact"), (F.abs(F.col("estimate") - F.col("exact")) <= 0.00501 * F.abs("exact")).alias("within"))


def _exact(rows: DataFrame) -> DataFrame:
    ranked = ordered.ranked(rows.select("event_type", "value"), [F.col("value").asc()], ["value"], "i", "row_number", within=["event_type"])
    total = rows.groupBy("event_type").agg(F.count("value").alias("n"))
    shares = F.explode(F.array(*map(F.lit, _SHARES)))
    places = total.select("event_type", "n", shares.alias("share")).select("event_type", "share", (F.floor(F.col("share") * (F.col("n") - 1)) + 1).alias("i"))
    return ranked.join(places, ["event_type", "i"]).select("event_type", "share", F.col("value").alias("exact"))


QUERIES["sketch_quantile_error"] = sketch_quantile_error
ORACLES["sketch_quantile_error"] = f"""WITH s AS (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in _SHARES)}]) AS share),
    r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, share, round(value, 6) AS exact, TRUE AS within FROM r, s WHERE i = floor(share * (n - 1))"""


def sketch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of each flag from the sketches of its days, beside the exact number."""
    rows = table(spark, sf_dir, "lineitem")
    days = S.distinct_sketch(rows, "l_partkey", ["l_returnflag", "l_shipdate"])
    merged = S.merge_distinct_sketches(days, ["l_returnflag"])
    whole = S.distinct_sketch(rows, "l_partkey", ["l_returnflag"], name="whole")
    exact = rows.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    near = F.abs(S.distinct_estimate("sketch") - F.col("exact")) <= 3 * 1.04 / 64 * F.col("exact")
    return merged.join(whole, "l_returnflag").join(exact, "l_returnflag").select("l_returnflag", "exact", near.alias("within"), (F.col("sketch") == F.col("whole")).alias("same"))


QUERIES["sketch_distinct"] = sketch_distinct
ORACLES["sketch_distinct"] = "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, TRUE AS within, TRUE AS same FROM lineitem GROUP BY 1"


def sketch_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent suppliers of each flag by the sketches of its months, with 40 counters each."""
    rows = table(spark, sf_dir, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    months = S.top_sketch(rows, "l_suppkey", ["l_returnflag", "month"], counters=40)
    merged = S.merge_top_sketches(months, ["l_returnflag"], counters=40)
    return merged.select("l_returnflag", F.inline(S.top_estimate("sketch", 40)))


QUERIES["sketch_top"] = sketch_top
ORACLES["sketch_top"] = """WITH c AS (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, l_suppkey::VARCHAR AS v, count(*) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, month ORDER BY n DESC, v) AS i FROM c),
    l AS (SELECT l_returnflag, month, coalesce(max(n) FILTER (i = 41), 0) AS less FROM r GROUP BY ALL),
    m AS (SELECT l_returnflag, v, sum(n - less)::BIGINT AS n FROM r JOIN l USING (l_returnflag, month) WHERE i <= 40 AND n > less GROUP BY ALL),
    e AS (SELECT l_returnflag, sum(less)::BIGINT AS error FROM l GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, v) AS i FROM m),
    o AS (SELECT l_returnflag, coalesce(max(n) FILTER (i = 41), 0) AS less FROM k GROUP BY ALL)
    SELECT l_returnflag, v AS value, n - less AS low, n - less + error + less AS high FROM k JOIN o USING (l_returnflag) JOIN e USING (l_returnflag) WHERE i <= 40 AND n > less"""


def group_aggregate_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [{"fn": "approx_percentile_90", "column": "l_extendedprice", "as": "p90"}, {"fn": "approx_top_3", "column": "l_linenumber", "as": "modes"}, {"fn": "count", "as": "n"}, {"fn": "approx_nunique", "column": "l_tax", "as": "taxes"}]
    found = run_pipeline(table(spark, sf_dir, "lineitem"), [{"op": "group_aggregate", "args": {"group_by": ["l_returnflag"], "aggs": aggs}}])
    return rounded(found.withColumn("modes", F.array_join("modes", ",")), 4)


QUERIES["group_aggregate_sketched"] = group_aggregate_sketched
ORACLES["group_aggregate_sketched"] = """WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
    c AS (SELECT l_returnflag, l_linenumber::VARCHAR AS v, count(*) AS n FROM lineitem GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, v) AS i FROM c),
    m AS (SELECT l_returnflag, string_agg(v, ',' ORDER BY i) AS modes FROM k WHERE i <= 3 GROUP BY 1),
    t AS (SELECT l_returnflag, count(DISTINCT l_tax) AS taxes FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(power(1.01 / 0.99, ceil(ln(x) / ln(1.01 / 0.99))) * 2 / (1.01 / 0.99 + 1), 4) AS p90, modes, n, taxes
    FROM r JOIN m USING (l_returnflag) JOIN t USING (l_returnflag) WHERE i = floor(0.9 * (n - 1))"""

for _name in ("sketch_quantiles", "sketch_quantile_error", "sketch_distinct", "sketch_top", "group_aggregate_sketched"):
    ORACLES[_name] = " ".join(ORACLES[_name].split())
