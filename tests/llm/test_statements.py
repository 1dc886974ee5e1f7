"""Every numbered query with a statement against DuckDB on the smallest data."""

import pytest

from floorledger.llm.queries import LLM_QUERIES
from floorledger.llm.statements import LLM_STATEMENTS
from tests.compare import differences, duck

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(LLM_STATEMENTS))
def test_query(spark, name):
    assert differences(LLM_QUERIES[name](spark, DIRECTORY), duck(DIRECTORY), LLM_STATEMENTS[name]) == ""
