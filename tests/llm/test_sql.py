"""Registered corpus queries against their SQL on the smallest tables."""

import compare
import pytest

from skeinwork.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert compare.differences(queries.QUERIES[name](spark, SF), compare.connect(SF), queries.ORACLE_SQL[name]) is None
