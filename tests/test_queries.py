"""Every registered query against the SQL that checks it, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from passrate.plans import queries as Q

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF_DIR)
    want = duck.execute(Q.oracle_sql()[name])
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows([d[0] for d in want.description], want.fetchall())


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())
