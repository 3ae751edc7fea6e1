"""Every registered query against its SQL, over the smallest tables."""

import pytest

from colloquy.plans.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, spark, duck, same_rows, data_dir):
    same_rows(QUERIES[name](spark, data_dir), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, data_dir):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(ORACLE) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
