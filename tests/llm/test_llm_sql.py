"""Registered queries against their SQL, over whole tables, and the pipeline against its stages."""

import duckdb
import pytest

import corpus_pipeline
from textloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    result = con.execute(registry.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


#: Searches vectors, not documents; its rows are compared with brute force in test_audit_merkle_polytope.
OF_VECTORS = {"op13_neighbours"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE) - OF_VECTORS))
def test_one_row_a_document_or_piece(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    df = registry.QUERIES[name](spark, SF)
    assert df.select("doc_id").distinct().count() == n and df.count() >= n


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema], name
        ids = {r[0] for r in after.select("doc_id").collect()}
        assert ids <= {r[0] for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(after.collect(), docs.schema)
    linked = registry.jaccard.link_components(kept).where("doc_id <> component_id").count()
    assert linked == 0
    pieces = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in pieces.select("doc_id").collect()} == {r[0] for r in kept.select("doc_id").collect()}
