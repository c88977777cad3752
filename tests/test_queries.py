"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from docloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, data, con, name):
    df = catalog.queries()[name](spark, data)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert got == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_flagship(spark, data):
    assert catalog.flagship(spark, data).count() > 0
