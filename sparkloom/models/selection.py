"""Feature selection: how much each column tells of a target, all columns from one long table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..session import share_package
from ..stats import distributions as D


def feature_scores(df: DataFrame, target: str, columns) -> DataFrame:
    """(column, n, levels, chi_square, dof, p_value, cramers_v, mutual_information) of each column, the most telling first.

    Columns are taken for categories (a column of numbers is cut into bins
    before).  Rows are counted by (column, value, target) in one aggregate with a
    map-side part; marginal counts are sums of these.  Rows with a null target, or a null in
    the column, are left out of the column's counts; a column without values has null scores.
    """
    names = compat.names(columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), compat.col(c).cast("string").alias("v")) for c in names]))
    long = df.filter(compat.col(target).isNotNull()).select(compat.col(target).cast("string").alias("t"), pairs.alias("e")).select("t", "e.*").filter("v is not null")
    cells = long.groupBy("column", "v", "t").agg(F.count("*").cast("double").alias("n"))
    by_value = cells.groupBy("column", "v").agg(F.sum("n").alias("nv"))
    by_target = cells.groupBy("column", "t").agg(F.sum("n").alias("nt"))
    totals = by_value.groupBy("column").agg(F.sum("nv").alias("total"), F.count("*").alias("levels"))
    outcomes = by_target.groupBy("column").agg(F.count("*").alias("outcomes"))
    both = cells.join(by_value, ["column", "v"]).join(by_target, ["column", "t"]).join(totals, "column").join(outcomes, "column")
    expected = F.col("nv") * F.col("nt") / F.col("total")
    # cells without rows add their expected number: the sum of n * n / expected less the total
    scores = both.groupBy("column").agg(
        F.max("total").cast("long").alias("n"),
        F.max("levels").alias("levels"),
        F.greatest(F.sum(F.col("n") * F.col("n") / expected) - F.max("total"), F.lit(0.0)).alias("chi_square"),
        ((F.max("levels") - 1) * (F.max("outcomes") - 1)).alias("dof"),
        F.least(F.max("levels"), F.max("outcomes")).alias("least"),
        F.greatest(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") / expected)), F.lit(0.0)).alias("mutual_information"),
    )
    share_package(df.sparkSession)

    @F.udf("double")
    def tail(x, dof):  # a row for each column
        return D.chi2_sf(x, dof) if x is not None and dof else None

    known = df.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(names)], "column string")
    out = known.join(scores, "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("levels", F.lit(0)).alias("levels"), "chi_square", "dof", tail("chi_square", "dof").alias("p_value"),
        F.when(F.col("least") > 1, F.sqrt(F.col("chi_square") / (F.col("n") * (F.col("least") - 1)))).alias("cramers_v"), "mutual_information",
    )
    return out.orderBy(F.col("mutual_information").desc_nulls_last(), "column")


def select_features(df: DataFrame, target: str, columns, k: int) -> list[str]:
    """The ``k`` columns that tell most of the target."""
    return [r["column"] for r in feature_scores(df, target, columns).filter("mutual_information is not null").limit(k).collect()]
