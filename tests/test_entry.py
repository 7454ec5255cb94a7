"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(found):
    def one(v):
        return ("nan" if math.isnan(v) else round(v, 4)) if isinstance(v, float) else v if isinstance(v, (int, bool, type(None))) else str(v)

    return sorted((tuple(map(one, r)) for r in found), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    sql = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(duck.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall())
