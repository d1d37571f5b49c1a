"""Every registered query of the library's own operators against its SQL twin."""

import pytest

from strataloom.plans import registry
from tests.comparing import duck_rows, spark_rows

SQL = registry.oracle_sql()


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf_dir, name):
    found = spark_rows(registry.queries()[name](spark, sf_dir))
    if name in SQL:
        assert found == duck_rows(SQL[name], sf_dir)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
