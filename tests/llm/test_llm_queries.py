import glob
import os

import duckdb
import pytest

from pulsegrid.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, name):
    got = Q.QUERIES[name](spark, sf).toArrow()
    if name in Q.SQL:
        c = duckdb.connect()
        for p in glob.glob(f"{sf}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        want = c.sql(Q.SQL[name]).to_arrow_table()
        assert sorted(map(repr, got.select(want.column_names).to_pylist())) == sorted(map(repr, want.to_pylist()))


def test_groups_stay_together(spark, sf):
    rows = Q.p4_splits(spark, sf).collect()
    assert all(len({r["split"] for r in rows if r["group_id"] == g}) == 1 for g in {r["group_id"] for r in rows})
