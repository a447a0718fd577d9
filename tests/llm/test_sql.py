from __future__ import annotations

import pytest
from oracle import compare, connect

from coppice.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
