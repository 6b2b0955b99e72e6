"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest
from tests.conftest import SMALL, as_rows

import __spark_entry__  # noqa: F401
from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    if name not in registry.ORACLES:
        assert len(got.columns)
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = as_rows(got), as_rows(want)
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    # In a large result, a value at the edge of rounding may fall either way.
    assert len(different) <= len(a) // 1000, different[:3]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
