"""Every registered query against its SQL, on tables long enough for day slices and 24-hour windows."""

import pytest

import __spark_entry__ as contract
from thermobox.catalog import QUERIES
from thermobox.oracles import sql
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(sql())
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name]) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 8 and df.columns[0] == "time"
