"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); component is the smallest node reachable.

    Each round is two aggregates with a map-side part and two joins on a node,
    which Spark may split where a node has very many neighbours; nothing is
    gathered per node and nothing goes to the driver but two numbers a round.
    Rounds end when the links don't change; they grow as the logarithm of the
    size.  Each round is written to the shared folder.  Loops and repeated
    edges are harmless; no edges give no rows.
    """
    links = common.stage(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct(),
        "links",
    )
    state = _state(links)
    while True:
        both = links.select("v", "m").union(links.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        # large star: larger neighbours move to the smallest of the neighbourhood
        large = both.filter("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = large.filter("v <> m").distinct()
        # small star: smaller neighbours move to the smallest of them
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(least, "v").select(
            F.when(F.col("m") == F.col("low"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("low").alias("m")
        )
        links = common.stage(small.filter("v <> m").distinct(), "links")
        now = _state(links)
        if now == state:
            break
        state = now
    roots = links.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return links.select(F.col("v").alias("node"), F.col("m").alias("component")).union(roots)


def _state(links: DataFrame) -> tuple:
    """Two numbers that tell whether the set of links has changed."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
