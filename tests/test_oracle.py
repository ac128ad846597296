"""Every core query with SQL gives the same rows as DuckDB."""

import pytest
from conftest import TESTDATA, compare

from verbarium.plans.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, queries()[name], oracle_sql()[name])


def test_every_core_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry_and_names(spark, duck):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["seg_id", "doc_id", "key", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
