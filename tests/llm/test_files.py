"""What is cut on the way has as many files as its rows need, whatever the number of shuffle partitions; all rows are in them."""

from pathlib import Path
from urllib.parse import urlparse

import pytest

from lorebase.llm import common, near_dedup, quality_rules


@pytest.fixture
def many_partitions(spark):
    """64 shuffle partitions that Spark doesn't put together."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def files(spark):
    folder = spark.sparkContext.getCheckpointDir()
    return sum(1 for _ in Path(urlparse(folder).path).rglob("part-*")) if folder else 0


@pytest.mark.parametrize("operator", [near_dedup.near_duplicates, quality_rules.judged])
def test_cuts_have_few_files(spark, many_partitions, operator):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = files(spark)
    assert operator(docs).count() == docs.count()
    assert files(spark) - before < 64


def test_cut_keeps_all_rows(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(common, "FILE_ROWS", 100)
    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS id").groupBy("id").count()
    for said, most in ((None, 64), (0, 1), (100, 1), (101, 2), (1000, 10), (10**9, 64)):
        cut = common.cut(rows, said)
        assert cut.rdd.getNumPartitions() == most and {r.id for r in cut.collect()} == set(range(1000))
