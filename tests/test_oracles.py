"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from portfolia.plans import ORACLES, QUERIES
from tools.check import connect, rows_of


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLES:
        assert got[1]
        return
    cur = con.execute(ORACLES[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert got == want


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "avg_risk_score" in df.columns


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())
