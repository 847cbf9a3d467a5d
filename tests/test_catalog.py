"""Every registered query against its SQL, on the smallest tables."""

import datetime
import os

import pytest

from lodegrid import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    expected = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, expected.fetchall())


def test_each_query_is_registered_with_its_sql():
    assert catalog.oracle_sql().keys() <= catalog.queries().keys()
    assert catalog.queries().keys() - catalog.oracle_sql().keys() == {"hierarchical_search", "enrichment_prompts", "many_names"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
