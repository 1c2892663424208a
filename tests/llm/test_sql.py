"""The registered SQL of this subpackage gives what its queries give on the given tables."""

import glob
import os

import duckdb
import pytest

from mediaspark.llm.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    expected = con.sql(ORACLE_SQL[name])
    columns = sorted(expected.columns)
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    want = sorted(str([plain(row[i]) for i in at]) for row in expected.fetchall())
    got = sorted(str([plain(row[c]) for c in columns]) for row in df.collect())
    assert got == want and got
