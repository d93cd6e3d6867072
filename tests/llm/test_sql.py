"""Registered queries of the subpackage against their SQL, on the smallest tables, where they are there."""

from __future__ import annotations

import pytest

from lectio.llm.queries import QUERIES, SQL
from tests.test_queries import DATA, plain, tables  # noqa: F401  a fixture


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):  # noqa: F811
    own = QUERIES[name](spark, DATA).toPandas()
    other = tables.execute(SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert plain(own) == plain(other)
