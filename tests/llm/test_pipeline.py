"""The pipeline, stage by stage, on the small tables."""

import importlib.util

import pytest
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline as cp  # noqa: E402

from .test_operators import brute_lines, brute_near, brute_substrings  # noqa: E402


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
        if k < 4:
            assert after.columns == list(cp.COLUMNS)
            assert after.where(F.col("n_chars") != F.length("text")).count() == 0
            got = {r.doc_id: r.text for r in after.collect()}
        if name == "quality_rules":
            clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
            long = {d for d, t in rows if len((t or "").split()) >= 10}
            assert len((clean & long) - set(got)) <= 0.02 * len(clean)
            assert all(got[d] == t for d, t in rows if d in got)
        elif name == "line_dedup":
            assert got == dict(brute_lines(rows))
        elif name == "minhash_near_dedup":
            _, comps = brute_near(rows, 5, 80)
            assert set(got) == {d for d in comps if comps[d] == d}
        elif name == "substring_dedup":
            assert [(str(d), " ".join((t or "").split())) for d, t in sorted(got.items(), key=lambda x: str(x[0]))] == [(d, " ".join(t.split())) for d, _, _, t in brute_substrings(rows)]
        else:
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {d for d, _ in rows}
        before = after


@pytest.mark.parametrize("rows", ["edges", "empty"])
def test_stages_with_nulls_and_without_rows(spark, sf, tmp_path, edges, rows):
    """Every stage on texts with nulls, blanks, repeats and a row without an id; and on no rows."""
    docs = edges.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    docs = docs.limit(0) if rows == "empty" else docs
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert (after.count() > 0) == (rows == "edges")
        if k < 4:
            assert after.columns == list(cp.COLUMNS)
            # Each stage alone, on all rows; the next takes the same, of which more are odd than the one before would leave.
            if name in ("line_dedup", "substring_dedup"):
                assert after.count() == docs.count()


def test_run_is_the_stages(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() > 0
    assert "sequence_id" in out.columns
