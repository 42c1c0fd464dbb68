"""Queries that SQL can express, against their SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from matchloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    ok, text = compare(spark, connect(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, text
