"""The registered queries of this subpackage against their SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sql_compare import DATA, database, same  # noqa: E402
from tidemark.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(spark, con, name):
    same(spark, con, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, con, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
