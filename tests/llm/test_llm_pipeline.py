import os

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and after
        before = after
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "repeats":
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert np.array([r.length for r in docs.collect()]).max() <= 4096
    assert [n for n, _ in pipeline.STAGES] == ["quality", "language", "near_duplicates", "repeats", "packing"]


def test_quality_stage_keeps_clean_documents(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r.doc_id for r in pipeline.quality_stage(spark, docs, DATA).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in docs.collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    for table in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
