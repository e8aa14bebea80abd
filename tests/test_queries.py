"""Every registered routing query against its SQL in DuckDB, on the smallest tables."""

import pytest
from conftest import DATA
from oracle import compare, duck

from quillon.plans import registry


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    compare(registry.queries()[name](spark, DATA), con, registry.oracle_sql()[name])


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
