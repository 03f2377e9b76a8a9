"""The queries that SQL can express, held against it on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from passrate.llm import queries as Q

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(checkpoints, spark, name):
    if not os.path.isdir(SF_DIR):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    got = Q.queries()[name](spark, SF_DIR)
    want = con.execute(Q.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(order)
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(want.fetchall())
