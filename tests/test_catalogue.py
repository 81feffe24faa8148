"""Every query of the core against its SQL on the smallest tables."""

import pytest

from strandline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(name, spark, small):
    frame = catalogue.QUERIES[name](spark, small)
    assert frame.columns and not frame.isEmpty()


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
