"""Registered operators against their SQL on the smallest tables."""

import duckdb
import pytest

from lorebase.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    base = duckdb.connect()
    for t in ("documents", "conversations"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    made = queries()[name](spark, DIR)
    wanted = base.sql(oracle_sql()[name])
    assert sorted(wanted.columns) == sorted(made.columns)
    assert sorted(str(tuple(r[c] for c in wanted.columns)) for r in made.collect()) == sorted(map(str, wanted.fetchall()))


def test_every_operator_is_registered():
    names = queries()
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
