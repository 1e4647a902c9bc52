"""Rows of a query against rows of SQL, as the driver compares them."""

import math
import os
from pathlib import Path

import duckdb

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
has_data = os.path.isdir(TESTDATA)


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, list | tuple):
        return repr([plain(v) for v in value])
    return str(value)


def same_rows(spark, f, sql):
    con = duckdb.connect()
    for path in Path(TESTDATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = f(spark, TESTDATA)
    columns = sorted(got.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())
