"""Every registered query against its DuckDB oracle at sf0.01 (as the driver does)."""

import pytest

from subsight.plans.catalog import all_queries

from .conftest import SF01
from .oracle_check import compare, duck

QUERIES = all_queries()
WITH_SQL = sorted(n for n, q in QUERIES.items() if q.sql)
ROWS_ONLY = sorted(n for n, q in QUERIES.items() if not q.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, con, name):
    problems, _ = compare(spark, name, QUERIES[name], SF01, con)
    assert not problems, problems


def test_every_query_has_an_oracle():
    assert ROWS_ONLY == []
