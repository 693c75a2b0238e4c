"""Registered corpus queries: against their SQL where they have one, and each has one query by number."""

import re

import pytest

from tests.compare import connect, differences
from thermobox.llm.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    numbers = [int(m[1]) for name in QUERIES if (m := re.match(r"op(\d+)_", name))]
    assert sorted(numbers) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == []
