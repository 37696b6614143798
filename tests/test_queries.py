"""Every registered query on the smallest tables, against its SQL check."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in cols] for r in df.collect())
    assert rows
    check = entry.oracle_sql().get(name)
    if check:
        cur = duck.execute(check)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert rows == sorted([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == entry.entry(spark).columns


def test_the_census_leaves_the_code_where_it_is(spark):
    from wane.plans.resolution_queries import QUERIES

    before = {t.name for t in spark.catalog.listTables()}
    QUERIES["call_site_census"](spark, "/root/testdata/sf0.001")
    assert {t.name for t in spark.catalog.listTables()} == before
