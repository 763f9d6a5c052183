"""Every registered query with SQL against DuckDB, and the entry."""

import duckdb
import pytest

import __spark_entry__ as contract
from orgweave import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_query(spark, sf_dir, con, name):
    df = contract.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    sql = library.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
