"""Each query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    made = QUERIES[name](spark, SF)
    want = db.sql(SQL[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert plain(made.collect(), made.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"subclusters"}))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert entry.entry(spark).limit(1).collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())
