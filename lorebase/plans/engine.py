"""Asking, teaching and forgetting: plans over whole tables of questions and sentences.

State is a set of DataFrames; every change gives a new set, which save() writes to a place of its own, so readers of the old one aren't disturbed.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..functions.lexicon import STOP_WORDS, Lexicon
from ..operators import index, knowledge, templates, topics, triples
from ..sources.readers import save as write
from ..sources.readers import upsert

GLOBAL = "global"
UNKNOWN = "I don't know"


@dataclass(frozen=True)
class State:
    sentences: DataFrame  #: id, topic, tokenList
    postings: DataFrame
    topic_index: DataFrame
    topic_words: DataFrame
    entries: DataFrame
    tuples: DataFrame
    vocabulary: DataFrame


def empty(spark: SparkSession) -> State:
    kinds = {"sentences": schema.SENTENCE, "postings": schema.POSTING, "topic_index": schema.TOPIC_INDEX, "topic_words": "word string, tag string, topic string, sentence_id string, sentence_no long", "entries": schema.KB_ENTRY, "tuples": schema.TUPLE, "vocabulary": schema.VOCAB}
    return State(**{k: spark.createDataFrame([], v) for k, v in kinds.items()})


def save(state: State, path: str) -> None:
    """Postings are laid out by topic, by which every search filters."""
    for f in fields(state):
        write(getattr(state, f.name), f"{path}/{f.name}", ["topic"] if f.name == "postings" else None)


def load(spark: SparkSession, path: str) -> State:
    return State(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(State)})


def _indexed(sentences: DataFrame, lexicon: Lexicon, drop_off: float) -> DataFrame:
    """Postings of sentences (call_id, sentence_no, id, topic, tokenList) in their topic and in the global one."""
    own = index.build_postings(sentences, lexicon, drop_off=drop_off)
    columns = ["word", "tag", "shard", "sentence_id", "offset", "topic", "score"]
    return own.select(columns).union(own.withColumn("topic", F.lit(GLOBAL)).select(columns)).distinct()


def teachable(sentences: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Sentences that say something: no order or question, with a verb and two words to search."""
    tokens = F.col("tokenList")
    good = sentences.where(~T.is_question(tokens) & ~T.is_imperative(tokens) & T.has_verb(tokens))
    asked = index.keywords(good.select(F.col("id").alias("query_id"), F.col("tokenList").alias("tokens")), lexicon, STOP_WORDS)
    return good.join(asked.where("n_keywords > 1").select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")


def teach(state: State, sentences: DataFrame, lexicon: Lexicon) -> State:
    """Add sentences (id, topic, tokenList), each a call of its own, to the topic of their user and the global one."""
    good = teachable(sentences.select("id", "topic", "tokenList"), lexicon)
    calls = good.select(F.col("id").alias("call_id"), F.lit(0).alias("sentence_no"), "id", "topic", "tokenList")
    return replace(state, sentences=upsert(state.sentences, good, ["id"]), postings=index.upsert_postings(state.postings, _indexed(calls, lexicon, 1.0)))


def unteach(state: State, ids: DataFrame) -> State:
    """Forget sentences in every topic."""
    gone = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    return replace(state, sentences=state.sentences.join(gone, "id", "left_anti"), postings=index.remove_sentences(state.postings, gone))


def save_topics(state: State, sentences: DataFrame, lexicon: Lexicon) -> State:
    """Replace topics by sentences (topic, sentence_no, id, tokenList): sentences, postings with drop-off, and word scores."""
    names = sentences.select("topic").distinct()
    old = delete_topics(state, names)
    words = topics.topic_words(sentences, lexicon)
    calls = sentences.select(F.col("topic").alias("call_id"), "sentence_no", "id", "topic", "tokenList")
    return replace(
        old,
        sentences=old.sentences.unionByName(sentences.select("id", "topic", "tokenList")),
        postings=old.postings.unionByName(_indexed(calls, lexicon, topics.DROP_OFF)),
        topic_index=old.topic_index.unionByName(topics.build_topic_index(words)),
        topic_words=old.topic_words.unionByName(words),
    )


def delete_topics(state: State, names: DataFrame) -> State:
    ids = state.sentences.join(names, "topic", "left_semi").select("id")
    keep = lambda rows: rows.join(names, "topic", "left_anti")
    return replace(state, sentences=keep(state.sentences), postings=index.remove_sentences(state.postings, ids), topic_index=keep(state.topic_index), topic_words=keep(state.topic_words))


def save_entries(state: State, entries: DataFrame, lexicon: Lexicon) -> State:
    """Upsert knowledge-base entries and their postings."""
    fresh = upsert(state.entries, entries.select("id", "topic", "json_data"), ["topic", "id"])
    sentences = knowledge.as_sentences(entries, knowledge.schemas(fresh))
    columns = ["word", "tag", "shard", "sentence_id", "offset", "topic", "score"]
    return replace(state, entries=fresh, postings=index.upsert_postings(state.postings, index.build_postings(sentences, lexicon).select(columns)))


def search_sentences(state: State, questions: DataFrame, lexicon: Lexicon) -> DataFrame:
    """questions (query_id, topic, tokens) -> query_id, sentence_id, text: from the user's topic, or from all if that has none; a question needs two words to search."""
    words = index.keywords(questions.select("query_id", "tokens"), lexicon).where("n_keywords > 1")
    named = words.join(questions.select("query_id", F.col("topic").alias("own")), "query_id")
    own = _search_own(state, named)
    rest = words.join(own.select("query_id").distinct(), "query_id", "left_anti")
    return index.fetch(own.unionByName(index.search(state.postings, rest, GLOBAL)), state.sentences).select("query_id", "sentence_id", "text")


def _search_own(state: State, named: DataFrame) -> DataFrame:
    """Each question in the topic that it names: topic and word together are the key."""
    key = lambda topic: F.concat_ws("\x1f", F.col(topic), F.col("word"))
    return index.search(state.postings.withColumn("word", key("topic")), named.withColumn("word", key("own")).drop("own"))


def ask(state: State, questions: DataFrame, lexicon: Lexicon, rules: templates.Rules, access: DataFrame, now, page_size: int = 10) -> DataFrame:
    """questions (query_id, topic, email, text, tokens) -> query_id, place, text: answers of templates, sentences and tuples in this order, or that nothing is known.

    Only texts of 1 to 254 bytes that ask or order something are answered.
    """
    good = questions.where(T.askable(F.col("text")) & (T.is_question(F.col("tokens")) | T.is_imperative(F.col("tokens"))))
    picked = templates.pick(templates.match(good.select("query_id", "text"), rules)).join(good.select("query_id", "topic", "email", "text"), "query_id")
    searching = F.col("template").startswith("db_search:")
    said = templates.searched_text(F.col("template"), F.col("star"))
    filled = picked.where(~searching & said.isNull()).select("query_id", F.lit(0).alias("place"), templates.fill(F.col("template"), F.col("star"), now, F.col("email")).alias("text"))
    parts = F.split("template", ":")
    lookups = picked.where(searching).select("query_id", parts[1].alias("topic"), F.transform(T.drop_spaces(T.tokenize("star")), lambda t: F.struct(t.alias("text"), F.lit("").alias("tag"))).alias("tokens"))
    words = index.keywords(lookups.select("query_id", "tokens"), lexicon).join(lookups.select("query_id", F.col("topic").alias("own")), "query_id")
    rows = _search_own(state, words).select("query_id", F.col("sentence_id").alias("id"))
    found = rows.join(knowledge.rendered(state.entries, knowledge.schemas(state.entries)), "id").select("query_id", F.lit(0).alias("place"), "text")
    told = search_sentences(state, good, lexicon).select("query_id", F.lit(1).alias("place"), "text")
    rephrased = picked.where(said.isNotNull()).select("query_id", "topic", F.transform(T.drop_spaces(T.tokenize(said)), lambda t: F.struct(t.alias("text"), F.lit("").alias("tag"))).alias("tokens"))
    looked = index.keywords(rephrased.select("query_id", "tokens"), lexicon).join(rephrased.select("query_id", F.col("topic").alias("own")), "query_id")
    retold = index.fetch(_search_own(state, looked), state.sentences).select("query_id", F.lit(0).alias("place"), "text")
    terms = triples.match_access(good.select("query_id", "tokens"), access, lexicon)
    blocks = triples.build_blocks(state.tuples)
    hits = triples.find(triples.wanted_lists(terms, triples.list_sizes(blocks)), blocks)
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("n") <= page_size).drop("n")
    facts = first.join(triples.decode(state.tuples.join(first.select("id").distinct(), "id", "left_semi"), state.vocabulary), "id").select("query_id", F.lit(2).alias("place"), "text")
    answers = filled.unionByName(found).unionByName(retold).unionByName(told).unionByName(facts)
    silent = good.join(answers.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(3).alias("place"), F.lit(UNKNOWN).alias("text"))
    return answers.unionByName(silent)
