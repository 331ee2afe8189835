"""The registered queries and the pipeline over the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_all_are_registered():
    import __spark_entry__ as driver

    names = set(driver.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names


def test_statements(spark):
    from titlelake.llm.queries import LLM_ORACLE, LLM_QUERIES

    for name, sql in LLM_ORACLE.items():
        assert difference(LLM_QUERIES[name](spark, SF_DIR), duck(SF_DIR), sql) is None, name


def test_pipeline(spark):
    import corpus_pipeline

    ids = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF_DIR}/documents.parquet'").fetchall()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns, name
        docs = corpus_pipeline.written(docs, name)
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept <= ids and len(kept) > 0.8 * len(ids)
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == kept
