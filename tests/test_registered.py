"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not supplied")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "benchmark", "conversations", "lineitem"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    # A long with nulls is a float in one engine's frames and an integer in the other's.
    def shown(v) -> str:
        if pd.isna(v):
            return "null"
        return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)

    return sorted(tuple(map(shown, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert len(got)
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        want = db.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
