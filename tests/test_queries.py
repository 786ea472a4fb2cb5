"""Every core query at the smallest scale: against DuckDB, or where SQL can't say the same against a plain version."""

import math

import duckdb
import pytest

import __spark_entry__
from plain_versions import PLAIN
from papyra.plans.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    found = df.collect()
    rows = sorted(str([plain(r[c]) for c in columns]) for r in found)
    assert rows, "a query over nothing"
    if name not in ORACLE_SQL:
        PLAIN[name](spark, D, found)
        return
    found = duck.sql(ORACLE_SQL[name])
    at = [found.columns.index(c) for c in sorted(found.columns)]
    assert sorted(found.columns) == columns
    assert sorted(str([plain(r[i]) for i in at]) for r in found.fetchall()) == rows


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
