"""Headline queries, one warm-up and the median of three timed runs each; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = ":".join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH", "")])])

HEADLINE = [
    "flagship", "filter_rows_safe", "group_aggregate", "count_distinct", "join_inner", "pivot", "unpivot", "top_n", "remove_duplicates",
    "find_duplicates", "z_score", "percentile", "quartiles", "outlier_detection", "correlation", "simple_linear_regression",
    "moving_average", "running_total", "rank_column_rank", "lag_column", "date_diff", "query_spec", "operation_describe", "profile",
    "analysis_correlation_matrix", "analysis_regression_ols", "analysis_mann_whitney",
]


def main() -> None:
    from sparkloom.queries import QUERIES
    from sparkloom.session import session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(median(runs[1:]), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, median of 3 after a warm-up, summed", "value": total, "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
