"""Every registered query against its SQL; the others give rows."""

import pytest

from roadloom.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, spark, duck, sf_dir, same_rows):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf_dir):
    rows = QUERIES[name](spark, sf_dir).collect()
    again = QUERIES[name](spark, sf_dir).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, again))


def test_entry_registers_every_query():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
