"""Every registered query beside its DuckDB text."""

import duckdb
import pytest

from __spark_entry__ import entry
from check import TABLES, canonical
from corpuscope.plans.oracle import SQL
from corpuscope.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(REGISTRY) == set(SQL)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    df, sql = REGISTRY[name](spark, SF), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    rows = [tuple(r) for r in df.collect()]
    assert rows and canonical(df.columns, rows) == canonical(sql.columns, sql.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
