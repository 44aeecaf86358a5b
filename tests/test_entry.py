import __spark_entry__ as driver
from checks import CHECKS


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert all(check.sql for check in CHECKS.values()) and set(CHECKS) <= set(driver.queries())


def test_entry(spark):
    profile = driver.entry(spark)
    assert profile.count() == 10 and "missing_percentage" in profile.columns
