"""Every registered query with SQL returns what DuckDB returns on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from mediaspark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(FOLDER, t)}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(v)


def test_queries_equal_sql(spark, duck):
    wrong = []
    for name, sql in registry.ORACLE_SQL.items():
        df = registry.QUERIES[name](spark, FOLDER)
        columns = sorted(df.columns)
        got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns, name
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
        if got != want:
            wrong.append(name)
    assert not wrong


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
