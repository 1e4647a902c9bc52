"""The queries of the training-data operators: against SQL, and over empty and dirty tables."""


import pytest
from compare import TESTDATA, has_data, same_rows

from siftgrid.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not has_data, reason="no test tables")
TABLES = ("article", "decision", "animal", "posting", "costats", "documents", "capacities")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    same_rows(spark, QUERIES[name], SQL[name])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{TESTDATA}/{t}.parquet").limit(0).coalesce(1).write.parquet(str(folder / f"{t}.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    """A row of nulls in each table, every row twice, and extra columns with names the operators use."""
    folder = tmp_path_factory.mktemp("dirty")
    for t in TABLES:
        rows = spark.read.parquet(f"{TESTDATA}/{t}.parquet").limit(40)
        rows = rows.unionByName(rows).unionByName(spark.createDataFrame([tuple([None] * len(rows.columns))], rows.schema))
        rows.selectExpr("*", "1 AS term", "'x' AS record", "2 AS cls", "'y' AS item", "3 AS f", "'z' AS kind").coalesce(1).write.parquet(str(folder / f"{t}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_dirty_tables(spark, dirty, name):
    rows = QUERIES[name](spark, dirty).collect()
    if name == "p6_ids":
        assert len(rows) == 81
    if name == "p4_found":
        assert rows == []
