"""The registered queries on the smallest tables agree with their SQL."""

import duckdb
import pytest

import __spark_entry__
from quillmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def shown(rows):
    return sorted(str(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    rows = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        assert rows.count() > 0
        return
    found = duck.sql(registry.ORACLE_SQL[name])
    order = sorted(rows.columns)
    assert order == sorted(found.columns)
    assert shown(rows.select(*order).collect()) == shown(found.select(*[f'"{c}"' for c in order]).fetchall())


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
