"""Every query of the general modules runs; where it has SQL, DuckDB gives the same rows."""

import glob
import os

import duckdb
import pytest

from pulsegrid.plans import dealt, engine

QUERIES, SQL = dealt.QUERIES | engine.QUERIES, dealt.SQL | engine.SQL


def norm(table):
    names = sorted(table.column_names)
    return sorted(repr([None if x != x else x for x in r]) for r in zip(*[table.column(n).to_pylist() for n in names])), names


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toArrow()
    if name in SQL:
        assert norm(got) == norm(duck.sql(SQL[name]).to_arrow_table())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
