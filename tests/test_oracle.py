"""Every core query against its SQL."""

import pytest
from oracle import duck, spark_rows

from sediment.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    got = spark_rows(registry.queries()[name](spark, small))
    assert got == duck(small, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, small, name):
    registry.queries()[name](spark, small).collect()


def test_entry_has_a_stable_schema(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
