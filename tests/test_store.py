"""Stored tables and the stored index: increments, pruning, and what they touch."""

import contextlib
import io
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lorebase.functions.lexicon import Lexicon
from lorebase.operators import boolean, index
from lorebase.operators.annotate import annotate_tokens
from lorebase.plans.queries import no_lexicon
from lorebase.plans.saved import SavedIndex, once
from lorebase.sources.store import LOGS, Layout, Table

LAYOUT = Layout("a string, b int, v string, w double", ["a", "b"], ["a"], ["a"], parts=8)


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def files(path) -> set[str]:
    return {os.path.relpath(f"{d}/{n}", path) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def parts(names) -> set[str]:
    return {re.search(r"part=(\d+)", n)[1] for n in names}


def test_increments_against_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    table, held = Table(spark, str(tmp_path / "t"), LAYOUT), {}
    assert table.read().count() == 0
    for step in range(9):
        rows = {(rng.choice(["x", "y", "z", None, f"k{rng.randrange(20)}"]), rng.choice([1, 2, None])): (rng.choice(["v", None, str(step)]), float(step)) for _ in range(6)}
        fresh = spark.createDataFrame([(*k, *v) for k, v in rows.items()], LAYOUT.schema)
        if step == 0:
            table.create(fresh)
        elif step % 3 == 2:
            gone = {k[0] for k in list(rows)[:2]}
            table.delete(spark.createDataFrame([(a,) for a in gone], "a string"))
            held = {k: v for k, v in held.items() if k[0] not in gone}
            rows = {}
        else:
            table.upsert(fresh)
        held |= rows
        if step == 6:
            table.compact()
        assert {(r.a, r.b): (r.v, r.w) for r in table.read().collect()} == held
        assert {(r.a, r.b): (r.v, r.w) for r in table.read({"a": ["x", "k3"]}).collect()} == {k: v for k, v in held.items() if k[0] in ("x", "k3")}
        wanted = spark.createDataFrame([("y",), (None,), ("y",)], "a string")
        assert {(r.a, r.b): (r.v, r.w) for r in table.read_for(wanted).collect()} == {k: v for k, v in held.items() if k[0] in ("y", None)}


def test_the_last_of_one_key_counts(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), LAYOUT)
    rows = spark.createDataFrame([("x", 1, "b", 1.0, 1), ("x", 1, "a", 9.0, 2), ("x", 1, "c", 3.0, 0)], LAYOUT.schema + ", at int")
    table.upsert(rows, "at")
    assert [tuple(r) for r in table.read().collect()] == [("x", 1, "a", 9.0)]
    table.upsert(rows)
    assert [tuple(r) for r in table.read().collect()] == [("x", 1, "c", 3.0)]


def test_changes_touch_their_partitions_only(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), LAYOUT)
    table.create(spark.createDataFrame([(f"k{k}", k, "v", 1.0) for k in range(200)], LAYOUT.schema))
    first = files(tmp_path)
    assert len(parts(first)) == 8
    table.upsert(spark.createDataFrame([("k5", 5, "new", 2.0)], LAYOUT.schema))
    table.delete(spark.createDataFrame([("k6",)], "a string"))
    now = files(tmp_path)
    own = {str(r[0]) for r in spark.createDataFrame([("k5",), ("k6",)], "a string").select(LAYOUT.part()).collect()}
    assert first < now and parts(now - first) == own and len(now - first) == 2
    table.compact()
    assert parts(files(tmp_path) - now) == own
    assert table.read().count() == 199 and not table.version()[2]
    old = table.version()
    assert sum(len(p) for _, p in old[1]) == 8


def test_logs_are_compacted_in_time(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), LAYOUT)
    for k in range(LOGS + 2):
        table.upsert(spark.createDataFrame([("k", k % 3, str(k), 1.0)], LAYOUT.schema))
    assert len(table.version()[2]) <= LOGS
    assert sorted((r.b, r.v) for r in table.read().collect()) == [(0, str(LOGS - 1)), (1, str(LOGS)), (2, str(LOGS + 1))]


def test_the_second_writer_of_a_version_fails(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), LAYOUT)
    table.create(spark.createDataFrame([("k", 1, "v", 1.0)], LAYOUT.schema))
    number, base, logs = table.version()
    table._commit(number + 1, base, logs)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        table._commit(number + 1, base, logs)


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    words = F.regexp_extract_all("txt", F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))
    return docs.select("doc_id", "source", F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), F.lit(0))).alias("s", "txt")).select(
        F.col("doc_id").alias("call_id"), F.col("s").alias("sentence_no"), F.format_string("%d-%d", "doc_id", "s").alias("id"), F.col("source").alias("topic"), annotate_tokens(words).alias("tokenList")
    )


@pytest.fixture(scope="module")
def saved(spark, texts, tmp_path_factory):
    made = lambda: (index.build_postings(texts, no_lexicon(spark)), texts.select("id", "topic", "tokenList"))
    return once(SavedIndex(spark, str(tmp_path_factory.mktemp("index"))), made)


def test_one_pruned_scan(saved):
    text = plan(saved.query("any(tion) and not any(ther) or any(ment)"))
    scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]+\n)*", text)
    assert len(scans) == 1 and "PartitionFilters: [part" in scans[0] and re.search(r"PushedFilters: \[.*In\(word, \[ment,ther,tion\]\)", scans[0])
    assert len(re.findall(r"(?<!Broadcast)Exchange \(", text.split("\n\n")[0])) == 1 and "SortMergeJoin" not in text


@pytest.mark.parametrize("query", ["any(tion)", "any(tion ment)", "any(tion) and any(ther)", "any(tion) or any(elle) and not any(ther)", "(any(tion) or any(elle)) and not (any(ther) and any(ment))", "any(que, noun) and not any(des, verb)", "any(nowhere) or any(tion)"])
def test_search_as_over_all_postings(spark, saved, query):
    tree, held = boolean.parse(query), saved.postings.read()

    def leaf(x):
        words = boolean.keywords_of(x, True)
        asked = spark.createDataFrame([(0, k, len(words), w, t) for k, (w, t) in enumerate(words)], "query_id int, keyword int, n_keywords int, word string, tag_wanted string")
        return index.search(held, asked).drop("query_id")

    made = saved.query(query, honor_modifiers=True)
    key = lambda rows: sorted((r.sentence_id, [tuple(m) for m in r.matches]) for r in rows.collect())
    assert key(made) == key(boolean.execute(tree, leaf))


def test_calls_as_sentences(spark, texts):
    calls = texts.groupBy("call_id", "topic").agg(F.sort_array(F.collect_list(F.struct("sentence_no", "id", "tokenList"))).alias("x"))
    calls = calls.select("topic", F.transform("x", lambda s: F.struct(s["id"].alias("id"), F.transform(s["tokenList"], lambda t: t["text"]).alias("words"))).alias("sentences"))
    plain = texts.withColumn("tokenList", F.transform("tokenList", lambda t: t.withField("tag", F.lit("")).withField("dep", F.lit("")).withField("semantic", F.lit(""))))
    columns = ["word", "tag", "sentence_id", "offset", "topic", "score"]
    one = index.build_call_postings(calls, no_lexicon(spark), drop_off=0.9).select(columns)
    two = index.build_postings(plain, no_lexicon(spark), drop_off=0.9).select(columns)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and not one.isEmpty()
    # The one exchange is that of the groupBy above, which makes the calls; the postings themselves need none.
    assert plan(one).count("Exchange (") == plan(calls).count("Exchange (")


def test_teach_and_forget(spark, saved):
    lexicon = Lexicon(*(spark.createDataFrame([], s) for s in ("word string, stem string", "word string, semantic string", "word string, synonym string", "compound string")))
    said = spark.createDataFrame([("n1", "peter", "The xylophone is green".split()), ("n2", "peter", "Is it green ?".split())], "id string, topic string, words array<string>")
    tokens = said.select("id", "topic", annotate_tokens(F.col("words")).alias("tokenList"))
    path, before = saved.postings.path, files(saved.postings.path)
    saved.teach(tokens, lexicon)
    fresh = files(path) - before
    assert parts(fresh) == {str(r[0]) for r in spark.createDataFrame([("xylophone",), ("green",), ("is",)], "word string").where(F.col("word").isin([r.word for r in saved.postings.read().where("sentence_id = 'n1'").collect()])).select(saved.postings.layout.part()).collect()}
    found = saved.texts(saved.search([[("xylophone", ""), ("green", "")]], "peter"))
    assert [(r.sentence_id, r.text) for r in found.collect()] == [("n1", "The xylophone is green")]
    assert saved.search([[("xylophone", "")]], "global").count() == 1
    total = saved.postings.read().count()
    saved.forget(spark.createDataFrame([("n1",), ("unknown",)], "id string"))
    assert parts(files(path) - before - fresh) == parts(fresh)
    assert saved.search([[("xylophone", "")]]).count() == 0 and saved.sentences.read().where("id = 'n1'").isEmpty() and saved.words.read().where("sentence_id = 'n1'").isEmpty()
    assert saved.postings.read().count() == total - 2 * len(parts(fresh))
