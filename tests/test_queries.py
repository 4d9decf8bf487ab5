"""Every registered query runs; those with SQL agree with DuckDB on the smallest tables."""

import compare
import pytest
from conftest import SMALL

from textloom import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert compare.difference(spark, duck, SMALL, plans.QUERIES[name], plans.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    df = plans.QUERIES[name](spark, SMALL)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
