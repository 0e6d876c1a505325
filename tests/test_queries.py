"""Every query of the voxel engine against its SQL twin in DuckDB, on the smallest tables."""

import pytest
from compare import rows_of

from stratavox.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf, duck):
    assert rows_of(QUERIES[name](spark, sf).toPandas()) == rows_of(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).limit(3).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 500
    assert set(e.oracle_sql()) <= set(e.queries())
