"""Every query of the catalogue against its SQL."""

import pytest
from compare import has_data, same_rows

import __spark_entry__ as driver
from siftgrid.plans.catalogue import QUERIES, SQL

needs_data = pytest.mark.skipif(not has_data, reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same_rows(spark, QUERIES[name], SQL[name])


def test_entry_points():
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(QUERIES) <= set(driver.queries())
