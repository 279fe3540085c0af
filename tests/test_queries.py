"""Every registered query against its SQL twin, on the smallest tables."""
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    message, _ = compare(spark, con, name, SF)
    assert message is None, message
