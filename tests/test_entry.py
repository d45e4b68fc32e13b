"""The driver's entry points."""

import __spark_entry__ as driver


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
