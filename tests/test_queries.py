"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from lorebase.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    base.sql("SET TimeZone='UTC'")
    for t in TABLES:
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return base


def plain(value):
    return f"{value:.5f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    made = QUERIES[name](spark, DIR)
    rows = made.collect()
    if name in SQL:
        wanted = duck.sql(SQL[name])
        columns = sorted(made.columns)
        assert sorted(wanted.columns) == columns
        place = {c: k for k, c in enumerate(wanted.columns)}
        assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[place[c]]) for c in columns) for r in wanted.fetchall())
    else:
        assert made.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
