"""The operators that SQL can express, against their SQL on the smallest tables."""

import pytest

from gridloom.llm.queries import ORACLES, QUERIES
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", list(ORACLES))
def test_query(spark, key):
    assert compare(QUERIES[key](spark, FOLDER), connect(FOLDER), ORACLES[key]) is None
