"""Topics that arrive as a stream, against those of one batch."""

import pytest
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import topics
from lorebase.operators.annotate import annotate_tokens
from lorebase.plans.queries import no_lexicon
from lorebase.plans.saved import SavedTopics
from lorebase.streaming import ingest

DOCS = "doc_id long, topic string, text string, ts timestamp"
FIRST = [(1, "cars", "Wheels turn. Wheels and doors! Doors closed.", "2024-01-01 10:00:00"), (2, "boats", "Sails turn. Wheels?", "2024-01-01 10:01:00")]
SECOND = [(1, "cars", "Wheels turn. Wheels and doors! Doors closed.", "2024-01-01 10:02:00"), (3, "cars", "One. Two. Three. Four. Wheels.", "2024-01-01 10:03:00"), (4, None, "Nothing known.", "2024-01-01 10:04:00"), (5, "cars", None, "2024-01-01 10:05:00")]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, topic string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def words_of(docs, lexicon):
    rows = docs.dropDuplicates(["doc_id"]).select("doc_id", "topic", F.posexplode(T.sentences("text")).alias("sentence_no", "txt"))
    return topics.topic_words(rows.select("topic", "sentence_no", F.concat_ws("-", "doc_id", "sentence_no").alias("id"), annotate_tokens(T.words("txt")).alias("tokenList")), lexicon)


def rows_of(index):
    return sorted((r.word, r.tag, r.topic or "", round(r.score, 5)) for r in index.collect())


@pytest.mark.parametrize("lateness", [None, "1 hour"])
def test_stream_is_the_batch(spark, tmp_path, lateness):
    lexicon, saved = no_lexicon(spark), SavedTopics(spark, str(tmp_path / "saved"), parts=2)
    for k, some in enumerate((FIRST, SECOND, FIRST)):
        documents(spark, some).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.document_stream(spark, str(tmp_path / "in"), documents(spark, FIRST).schema)
        ingest.topic_stream(stream, lexicon, saved, str(tmp_path / "state"), lateness).awaitTermination()
        told = words_of(documents(spark, (FIRST, FIRST + SECOND, FIRST + SECOND)[k]), lexicon)
        for mode in ("last", "sum"):
            assert rows_of(saved.index(mode)) == rows_of(topics.build_topic_index(told, mode))
    asked = spark.createDataFrame([(1, "wheels", "NN"), (1, "sails", "NN")], "query_id int, word string, tag string")
    for mode in ("last", "sum"):
        assert sorted(map(tuple, saved.rank(asked, mode).collect())) == sorted(map(tuple, topics.rank_topics(asked, topics.build_topic_index(told, mode)).collect()))


def test_forgotten_topics_can_be_told_again(spark, tmp_path):
    lexicon, saved = no_lexicon(spark), SavedTopics(spark, str(tmp_path), parts=2)
    told = words_of(documents(spark, FIRST + SECOND), lexicon)
    saved.add(told)
    saved.forget(spark.createDataFrame([("cars",), ("unknown",)], "topic string"))
    assert rows_of(saved.index()) == rows_of(topics.build_topic_index(told.where("topic <> 'cars' or topic is null")))
    again = words_of(documents(spark, FIRST), lexicon).where("topic = 'cars'")
    saved.add(again)
    saved.add(again)  # as a batch that is run twice
    wanted = told.where("topic <> 'cars' or topic is null").unionByName(again)
    for mode in ("last", "sum"):
        assert rows_of(saved.index(mode)) == rows_of(topics.build_topic_index(wanted, mode))
    assert {r.word for r in saved.index(words=["wheels", "none"]).collect()} == {"wheels"}


def test_a_broken_change_is_in_nobodys_way(spark, tmp_path):
    saved = SavedTopics(spark, str(tmp_path), parts=2)
    row = spark.createDataFrame([("a", "NN", "t", "s", 1)], "word string, tag string, topic string, sentence_id string, sentence_no long")
    saved.add(row)
    # A log without its commit, as a lost driver leaves it.
    saved.scores._write(row.select("word", "tag", "topic", F.lit(9).cast("long").alias("last"), F.lit("put").alias("op")), saved.scores._name("log", 1))
    assert rows_of(saved.index()) == [("a", "NN", "t", 0.98)]
    saved.add(row.withColumn("sentence_no", F.lit(2).cast("long")))
    assert rows_of(saved.index()) == [("a", "NN", "t", 0.9604)]


def test_topic_pages(spark):
    rows = spark.createDataFrame([(t, t * 2) for t in "cab"], "topic string, body string")
    assert [r.topic for r in topics.list_topics(rows, "null", 2).collect()] == ["a", "b"] and [r.topic for r in topics.list_topics(rows, "a", 5).collect()] == ["b", "c"]
    with pytest.raises(ValueError, match="page"):
        topics.list_topics(rows, None, 0)
