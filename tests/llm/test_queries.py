"""The registered queries run on the smallest tables, and agree with their SQL."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from quillmill.llm import registry

SF = "/root/testdata/sf0.001"
NAMES = [f"op{k}_" for k in range(1, 11)]


def value(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    rows = registry.queries()[name](spark, SF)
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = connection.sql(registry.oracle_sql()[name])
    order = sorted(rows.columns)
    assert order == sorted(found.columns)
    want = sorted((str(tuple(map(value, r))) for r in found.select(*[f'"{c}"' for c in order]).fetchall()))
    assert sorted(str(tuple(map(value, r))) for r in rows.select(*order).collect()) == want


def test_one_query_for_each_operator():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(k) for n in names) == 1 for k in NAMES) and "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, SF)
        assert after.columns == docs.columns, name
        assert after.count() <= held.count()
        held = after
    packed = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in held.collect()}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept and kept
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
