"""Every corpus query with SQL gives the same rows as DuckDB; the others run."""

import pytest
from conftest import TESTDATA, compare

from verbarium.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, duck, name):
    assert queries()[name](spark, TESTDATA).count() > 0
