"""Every registered query against its oracle SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as registered
from compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, connection, name):
    df = registered.queries()[name](spark, SF_DIR)
    sql = registered.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, connection, sql) is None


def test_every_oracle_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
