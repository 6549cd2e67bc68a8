"""Every registered query against its DuckDB oracle at sf0.001 (the driver
runs the same check at sf0.01), and the entry point smoke check."""

from __future__ import annotations

import pytest

from conftest import SF0001
from oracle_compare import canon, duck

import __spark_entry__ as E
from logmold.plans.catalog import QUERIES as CORE

# The corpus queries have their own tests in tests/llm.
QUERIES = {k: v for k, v in E.queries().items() if k in CORE}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in CORE}


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF0001)
    srows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLE:
        assert name in E.ROWS_ONLY and len(srows) > 0
        return
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert canon(srows, sdf.columns) == canon(drows, dcols)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) - E.ROWS_ONLY
    assert not E.ROWS_ONLY
