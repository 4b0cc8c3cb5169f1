"""Stages take effect, keep the columns of documents, and handle odd rows."""

import corpus_pipeline
import pytest
from fixtures import none, odd

from netweave.llm import queries


@pytest.fixture
def folder(spark, tmp_path, sf):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_stages_keep_columns(spark, folder):
    for rows in (odd(spark), none(spark)):
        docs = rows
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{folder}/{name}-{rows.count()}"
            stage(spark, docs, folder).write.parquet(path)
            if i < len(corpus_pipeline.STAGES) - 1:
                docs = spark.read.parquet(path)
                assert docs.columns == rows.columns and docs.dtypes == rows.dtypes
    assert spark.read.parquet(path).count() == 0


def test_pipeline_on_test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    junk = [i for i, r in labels.items() if r.quality == 0]
    assert kept < {r.doc_id for r in docs.select("doc_id").collect()}
    assert sum(i in kept for i in junk) <= 0.1 * len(junk) + 1


def test_registered():
    names = set(queries.QUERIES)
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} and len(names) == 13
