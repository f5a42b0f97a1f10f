"""Each query against its SQL, and the entry points that the driver calls."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from lanternlake.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, same, name):
    same(registry.queries()[name](spark, sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).collect() is not None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
    assert set(registry.queries()) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_has_a_stable_schema(spark):
    assert entry_point.entry(spark).columns == entry_point.entry(spark).columns
