import pytest
from oracle import compare, connect

from checks import CHECKS

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, c in CHECKS.items() if c.sql])
def test_same_rows_as_sql(spark, con, name):
    check = CHECKS[name]
    assert compare(spark, con, SF, check.query, check.sql) is None


@pytest.mark.parametrize("name", [n for n, c in CHECKS.items() if not c.sql])
def test_has_rows(spark, name):
    assert CHECKS[name].query(spark, SF).count() > 0
