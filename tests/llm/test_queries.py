"""The corpus queries that SQL can express against it."""

import os

import pytest

from helixframe.llm import catalog
from tests.oracle import DATA, compare


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
