"""The corpus queries that have SQL beside DuckDB's answers."""

import pytest

from juryloom.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) == ""
