"""The driver's contract, and that the corpus folders can be deleted."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tests.conftest import SF

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["flagship", "date_part", "running_total_at_scale", "rank_column_dense_rank_at_scale", "group_aggregate", "analysis_correlation_kendall", "join_full", "profile", "sketch_top", "concept_cross_validation", "ingest_excel", "concept_decision_trees", "concept_p_value_t"])
def test_queries_match_their_sql(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = e.queries()[name](spark, SF), con.sql(e.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    near = lambda v: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    want = sorted((tuple(r[sql.columns.index(c)] for c in names) for r in sql.fetchall()), key=str)
    assert len(got) == len(want) and all(g == tuple(map(near, w)) for g, w in zip(got, want))


WHOLE = ["cumulative_product_whole", "cumulative_product_at_scale", "exponential_moving_average_whole", "exponential_moving_average_at_scale", "join_right_whole", "join_full_whole"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table_queries_match_their_sql(spark, name):
    import __spark_entry__ as e

    test_queries_match_their_sql(spark, name)
    rows = e.queries()[name](spark, SF).collect()
    if name.startswith("join"):
        assert any(r[0] is None for r in rows) and (name == "join_right_whole" or any(r[1] is None for r in rows))
    else:
        assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count() > 500


def test_the_rest_imports_without_the_corpus_folders(tmp_path):
    """Copies what remains when the corpus package and pipeline are deleted."""
    import shutil

    shutil.copytree(ROOT / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
