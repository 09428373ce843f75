"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from lintlake import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 8) if isinstance(v, float) or hasattr(v, "is_finite") else v


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_sql(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    answer = duck.sql(catalog.oracle_sql()[name])
    assert sorted(answer.columns) == names
    at = [answer.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=repr)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
