"""What the stored index writes and shuffles: a query's own tables, packed rows, one exchange for an upsert, and no sentences that nobody asked for."""

import re
import shutil
from pathlib import Path

import pytest

from lorebase.operators import index
from lorebase.plans.queries import QUERIES, saved_index, saved_place
from lorebase.plans.saved import POSTINGS
from lorebase.sources.store import Layout, Table, compressed, shared_folder

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """Another path to the tables, under which nothing is stored yet."""
    shutil.copytree(SMALL, tmp_path / "in", copy_function=lambda a, b: Path(b).symlink_to(a))
    return str(tmp_path / "in")


def stored(spark, tables: str) -> set[str]:
    place = Path(re.sub("^file:/*", "/", saved_place(spark, tables, "index")))
    return {p.name for p in place.iterdir()} if place.exists() else set()


def test_a_query_writes_its_own_tables(spark, tables):
    assert shared_folder(spark)
    QUERIES["posting_words"](spark, tables)
    assert stored(spark, tables) == {"words"}
    QUERIES["bool_or"](spark, tables)
    assert stored(spark, tables) == {"words", "postings"}
    QUERIES["sentence_fetch"](spark, tables)
    assert stored(spark, tables) == {"words", "postings", "sentences"}
    saved = saved_index(spark, tables)
    own = lambda rows: sorted(map(tuple, rows.select("sentence_id", "word", "shard").collect()))
    assert own(saved.words.read()) == own(index.words_of_sentences(saved.postings.read()))


def test_packed_rows_come_back(spark):
    rows = [(f"w{k % 7}", "NN" if k % 2 else None, 0, f"s{k}", k, None if k % 3 else "t", k / 8) for k in range(500)]
    given = spark.createDataFrame(rows, POSTINGS.schema).repartition(3)
    made = compressed(POSTINGS, given)
    assert sorted(map(str, made.drop("part").collect())) == sorted(map(str, given.collect()))
    assert made.where(made["part"] != POSTINGS.part()).count() == 0
    assert compressed(POSTINGS, given.limit(0)).count() == 0


def test_an_upsert_deals_once(spark, tmp_path, monkeypatch):
    """Rows of one key are settled where they are dealt to for the files."""
    seen = []
    monkeypatch.setattr(Table, "_put", lambda self, laid, folder: seen.append(laid) or [])
    Table(spark, str(tmp_path / "t"), Layout("k string, n long, v string", ["k", "n"], ["k"], ["k"])).upsert(spark.range(50).selectExpr("cast(id % 5 as string) as k", "id % 3 as n", "'x' as v"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1


def test_unwanted_sentences_stay(spark, tables):
    """Before the texts meet what was found, a bitmap of it stands."""
    made = QUERIES["sentence_fetch"](spark, tables)
    assert "bitmap_construct_agg" in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == QUERIES["sentence_fetch"](spark, SMALL).count()
