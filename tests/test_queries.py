from __future__ import annotations

import pytest
from conftest import SF
from oracle import compare, connect

from coppice import queries as Q

SLOW = {"search_hybrid_topk"}


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - SLOW))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    if name in Q.SQL:
        assert compare(df, db, Q.SQL[name]) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
