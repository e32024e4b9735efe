"""Every registered query against its SQL on the same files."""

import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if k.startswith("q_")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, sf, con):
    got = __spark_entry__.queries()[name](spark, sf)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.queries() if k.startswith("q_") and k not in SQL))
def test_other_queries_have_rows(name, spark, sf):
    assert __spark_entry__.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
