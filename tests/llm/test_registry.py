"""Queries with a SQL twin against it, and the names that the entry module lists."""

import pytest

import __spark_entry__
from basinframe.llm import registry

from ..oracle import compare, database


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    compare(spark, database(), registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(registry.QUERIES) | {"pipeline"} <= set(names)
