"""The stages one after the other against plain loops, on the smallest table."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm import common, quality
from sparkloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.llm.data import LONG, documents, prose
from tests.llm.test_text_operators import brute_decontaminate, brute_keep, brute_lines


def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    dropped = {d: k for d, _, _, k in brute_lines(list(rows.items()))}
    staged = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        staged = common.stage(stage(spark, staged, SF), name)
        assert staged.columns == docs.columns
        now = {r.doc_id: r.text for r in staged.collect()}
        if name == "quality_rules":
            assert now == rows
        elif name == "line_dedup":
            assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in now.items()} == dropped
        elif name == "near_dedup":
            own = sorted(rows.items())
            assert set(now) == {own[i][0] for i in brute_keep(own)}
        else:
            bench = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
            assert set(now) == {w[0] for w in brute_decontaminate(list(rows.items()), bench) if not w[-1]}
        rows = now
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(rows)
    assert max(Counter(r.sequence_id for r in packed for _ in range(r.length)).values()) <= 1024


def awkward(spark, tmp_path):
    """A folder whose documents have nulls, empty and very long texts, repeated rows, and names that operators use inside."""
    docs = documents(spark).withColumns({"row": F.lit(1), "fp": F.lit("x"), "c0": F.lit(2.0), "n_chars": F.length("text").cast("long")})
    more = documents(spark, [prose(50 + i, 150) + "\nline one is long enough, shared" for i in range(4)] + [LONG, prose(51, 150)], extra=False)
    more = more.withColumn("doc_id", F.col("doc_id") + 100).withColumns({"row": F.lit(None).cast("int"), "fp": F.lit("y"), "c0": F.lit(None).cast("double"), "n_chars": F.length("text").cast("long")})
    path = str(tmp_path)
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    items = [(1, " ".join(prose(52, 150).split()[20:40])), (2, None), (None, "word")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    path = awkward(spark, tmp_path)
    staged = common.table(spark, path, "documents")
    bench = [(r.item_id, r.text) for r in common.table(spark, path, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in staged.collect()]
        schema = staged.schema
        staged = common.stage(stage(spark, staged, path), name)
        assert staged.schema == schema
        now = Counter((r.doc_id, r.text) for r in staged.collect())
        assert now and (name == "line_dedup" or not now - Counter(before))
        if name == "quality_rules":
            assert all(len((t or "").split()) >= 50 for _, t in now)
        elif name == "line_dedup":
            want = Counter((d, k) for d, _, _, k in brute_lines(before))
            assert Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in now.elements()) == want
        elif name == "near_dedup":
            assert now == Counter(before[i] for i in brute_keep(before)) and len(now) < len(before)
        else:
            hit = [w[-1] for w in brute_decontaminate(before, bench)]
            assert now == Counter(b for b, h in zip(before, hit) if not h) and any(hit)
    packed = corpus_pipeline.run(spark, path).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, _ in now.elements())


def test_pipeline_on_no_documents(spark, tmp_path):
    import corpus_pipeline

    path = awkward(spark, tmp_path)
    common.table(spark, path, "documents").limit(0).write.parquet(f"{path}/none/documents.parquet")
    common.table(spark, path, "benchmark").write.parquet(f"{path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{path}/none").count() == 0


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES][:10] == [f"op{i}" for i in range(1, 11)] and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)
