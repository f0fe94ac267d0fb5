"""Each query with SQL against DuckDB, all others for rows, on the smallest tables."""

from __future__ import annotations

import pytest

from locusframe.plans.catalogue import ORACLE_SQL, QUERIES

from . import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect(oracle.SF001)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLE_SQL[name], oracle.SF001) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, oracle.SF001).limit(5).count() > 0
