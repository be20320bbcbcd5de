"""Streaming ingest: documents that arrive become postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..functions.lexicon import Lexicon
from ..operators.annotate import annotate_tokens, surface_tokens
from ..operators.index import build_postings
from ..operators.topics import topic_words
from ..plans.saved import SavedTopics


def sentences_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, topic, text) -> call_id, sentence_no, id, topic, tokenList."""
    rows = docs.select("doc_id", "topic", F.posexplode(T.sentences("text")).alias("sentence_no", "txt"))
    return rows.select(F.col("doc_id").alias("call_id"), "sentence_no", F.concat_ws("-", "doc_id", "sentence_no").alias("id"), "topic", surface_tokens(T.words("txt")).alias("tokenList"))


def index_stream(docs: DataFrame, lexicon: Lexicon, path: str, checkpoint: str) -> StreamingQuery:
    """Write the postings of each batch to a partition of its own, which a batch that is run again replaces, so none is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        postings = build_postings(sentences_of(batch), lexicon)
        postings.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def topic_stream(docs: DataFrame, lexicon: Lexicon, saved: SavedTopics, checkpoint: str, lateness: str | None = None) -> StreamingQuery:
    """Documents (doc_id, topic, text) that arrive become words of topics, scored at once; the stored index is the state, so topics can be forgotten between batches.

    With `lateness`, docs have a time ts, and a document that comes again within it is dropped before its words are taken; one that comes later changes nothing, either.
    """
    fresh = docs.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["doc_id"]) if lateness else docs
    rows = fresh.select("doc_id", "topic", F.posexplode(T.sentences("text")).alias("sentence_no", "txt"))
    tagged = rows.select("topic", "sentence_no", F.concat_ws("-", "doc_id", "sentence_no").alias("id"), annotate_tokens(T.words("txt")).alias("tokenList"))

    def write(batch: DataFrame, number: int) -> None:
        words = topic_words(batch, lexicon).persist()
        saved.add(words)
        words.unpersist()

    return tagged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events (ts, event_type) counted in windows, late ones up to `lateness`."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def document_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
