"""The engine's indexes as stored tables: written once, read by word, and changed by increments."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.lexicon import Lexicon
from ..operators import boolean, index, topics, triples
from ..sources.store import Layout, Table
from .engine import GLOBAL, teachable

BITS = 1 << 24  #: of the bitmap by which sentences are told to be wanted; 2 MB
PARTS = 16  #: of each stored table, where no other number is given; it stays the same for the life of a table
BLOCKS = Layout("predicate long, word long, block long, n int, least long, greatest long, offsets array<int>", ["word", "predicate", "block"], ["word"], ["word", "predicate"], sort=["word", "predicate", "block"])
SIZES = Layout("predicate long, word long, n long", ["word", "predicate"], ["word"], ["word", "predicate"])
POSTINGS = Layout(schema.POSTING, index.KEY, ["word"], ["word", "shard", "sentence_id"], sort=["word", "topic", "sentence_id", "offset"])
WORDS = Layout("sentence_id string, word string, shard int", ["sentence_id", "word", "shard"], ["sentence_id"], ["sentence_id"])
SENTENCES = Layout(schema.SENTENCE, ["id"], ["id"], ["id"])
TOPIC_WORDS = Layout("word string, tag string, topic string, sentence_id string, sentence_no long", ["word", "tag", "topic", "sentence_id", "sentence_no"], ["word"], ["word", "topic"], sort=["word", "topic"])
TOPIC_SCORES = Layout("word string, tag string, topic string, last long", ["word", "tag", "topic"], ["word"], ["word", "topic"], sort=["word", "topic"])
TOPIC_PLACES = Layout("topic string, word string", ["topic", "word"], ["topic"], ["topic"])


class SavedIndex:
    """Postings laid out by word, the words of each sentence laid out by sentence, and the sentences, under one path.

    Forgetting a sentence looks up its words first, so that only their partitions are touched.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.postings, self.words, self.sentences = (Table(spark, f"{path}/{name}", replace(layout, parts=parts)) for name, layout in (("postings", POSTINGS), ("words", WORDS), ("sentences", SENTENCES)))

    def exists(self) -> bool:
        return self.sentences.version()[0] > 0

    def create(self, postings: DataFrame, sentences: DataFrame) -> None:
        """The first version; the sentences come last, so that what was broken off doesn't exist. Postings are read back for the words, not built twice."""
        for table, rows in ((self.postings, lambda: postings), (self.words, lambda: index.words_of_sentences(self.postings.read())), (self.sentences, lambda: sentences)):
            if not table.version()[0]:
                table.create(rows())

    def fill(self, **makers: Callable[[], tuple]) -> None:
        """The first version of those of its tables that are named and aren't there, each as its maker gives it: rows and how they travel. What is asked of the index needs its own tables only."""
        for name, make in makers.items():
            table = getattr(self, name)
            if not table.version()[0]:
                table.create(*make())

    def add(self, sentences: DataFrame, postings: DataFrame) -> None:
        self.postings.upsert(postings)
        self.words.upsert(index.words_of_sentences(postings))
        self.sentences.upsert(sentences)

    def teach(self, sentences: DataFrame, lexicon: Lexicon) -> None:
        """Sentences (id, topic, tokenList) that say something, in the topic of their user and the global one."""
        good = teachable(sentences.select("id", "topic", "tokenList"), lexicon)
        calls = good.select(F.col("id").alias("call_id"), F.lit(0).alias("sentence_no"), "id", "topic", "tokenList")
        own = index.build_postings(calls, lexicon)
        self.add(good, own.unionByName(own.withColumn("topic", F.lit(GLOBAL))))

    def forget(self, ids: DataFrame) -> None:
        """Sentences go from every topic."""
        gone = ids.select(F.col(ids.columns[0]).alias("sentence_id")).distinct()
        self.postings.delete(self.words.read_for(gone))
        self.words.delete(gone)
        self.sentences.delete(gone.withColumnRenamed("sentence_id", "id"))

    def read(self, words: Iterable[str], topic: str | None = None, shard: int = 0) -> DataFrame:
        """The postings of some words, out of the files that hold them."""
        rows = self.postings.read({"word": sorted({w.lower() for w in words})}).where(F.col("shard") == shard)
        return rows if topic is None else rows.where(F.col("topic") == topic)

    def search(self, wanted: list[list[tuple[str, str]]], topic: str | None = None) -> DataFrame:
        """query_id, sentence_id, matches: the sentences that have all words of a list, each under a fitting tag; the lists are numbered from 0."""
        rows = [(q, k, len(words), w.lower(), tag) for q, words in enumerate(wanted) for k, (w, tag) in enumerate(words)]
        asked = self.postings.spark.createDataFrame(rows, "query_id int, keyword int, n_keywords int, word string, tag_wanted string")
        return index.search_read(self.read((r[3] for r in rows), topic), asked)

    def query(self, text: str, topic: str | None = None, honor_modifiers: bool = False) -> DataFrame:
        """sentence_id, matches of a query in the boolean language: one scan of its words' postings, and one exchange by sentence."""
        tree = boolean.parse(text)
        if tree is None:
            raise boolean.QueryError("nothing to search")
        return boolean.combine(tree, self.search([boolean.keywords_of(leaf, honor_modifiers) for leaf in boolean.leaves(tree)], topic))

    def texts(self, found: DataFrame) -> DataFrame:
        """What was found with the text of its sentences. Those that a bitmap of the found ones, of fixed size, doesn't know are left where they are; the others meet what was found."""
        bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
        bits = found.select(bit("sentence_id").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
        place = F.bitmap_bit_position(bit("id"))
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        known = (F.bitmap_bucket_number(bit("id")) == F.col("_bucket")) & (byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (place % 8 + 1).cast("int"))) != 0)
        return index.fetch(found, self.sentences.read().join(F.broadcast(bits), known, "left_semi"))


class SavedTopics:
    """The words of topics by sentence, the last sentence of each word in a topic, both laid out by word, and the words of each topic, laid out by topic, under one path.

    Every change can be made again with the same outcome, so a batch of a stream that is run twice counts once.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.words, self.scores, self.places = (Table(spark, f"{path}/{name}", replace(layout, parts=parts)) for name, layout in (("words", TOPIC_WORDS), ("scores", TOPIC_SCORES), ("places", TOPIC_PLACES)))

    def add(self, rows: DataFrame) -> None:
        """Words of topics (word, tag, topic, sentence_id, sentence_no). What is known of a word is read out of its partitions; a repeated row changes nothing."""
        key = ["word", "tag", "topic"]
        rows = rows.select(*key, F.col("sentence_id").cast("string").alias("sentence_id"), F.col("sentence_no").cast("long").alias("sentence_no"))
        newest = rows.groupBy(*key).agg(F.max("sentence_no").alias("last"))
        known = self.scores.read_for(newest)
        self.places.upsert(rows.select("topic", "word").distinct())
        self.words.upsert(rows)
        self.scores.upsert(newest.unionByName(known), order="last")

    def forget(self, names: DataFrame) -> None:
        """Topics go, all their words with them; only partitions of these words are touched. The words of a topic go last, so that a broken run can be made again."""
        gone = names.select("topic").distinct()
        words = self.places.read_for(gone)
        self.scores.delete(words)
        self.words.delete(words)
        self.places.delete(gone)

    def index(self, mode: str = "last", words: Iterable[str] | None = None) -> DataFrame:
        """word, tag, topic, score as build_topic_index gives them for all that was added; with `words`, out of their partitions only."""
        keys = None if words is None else {"word": sorted(set(words))}
        if mode == "last":
            return self.scores.read(keys).select("word", "tag", "topic", topics.stored(F.pow(F.lit(topics.DROP_OFF), F.col("last"))).alias("score"))
        return topics.build_topic_index(self.words.read(keys), mode)

    def rank(self, texts: DataFrame, mode: str = "last") -> DataFrame:
        """texts (query_id, word, tag) -> query_id, topic, score, out of the partitions of their words."""
        if mode == "last":
            held = self.scores.read_for(texts).select("word", "tag", "topic", topics.stored(F.pow(F.lit(topics.DROP_OFF), F.col("last"))).alias("score"))
        else:
            held = topics.build_topic_index(self.words.read_for(texts), mode)
        return topics.rank_topics(texts, held)


class SavedTriples:
    """The posting lists of a triple store in blocks, and how long they are, laid out by word under one path."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.blocks, self.sizes = Table(spark, f"{path}/blocks", replace(BLOCKS, parts=parts)), Table(spark, f"{path}/sizes", replace(SIZES, parts=parts))

    def exists(self) -> bool:
        return self.sizes.version()[0] > 0

    def create(self, tuples: DataFrame) -> None:
        """Write the blocks of tuples; their sizes are read back from them."""
        if not self.blocks.version()[0]:
            self.blocks.create(triples.build_blocks(tuples))
        self.sizes.create(triples.list_sizes(self.blocks.read()))

    def find(self, terms: DataFrame) -> DataFrame:
        """terms (query_id, term) -> query_id, id; blocks are read out of the partitions that hold a wanted word."""
        lists = triples.wanted_lists(terms, self.sizes.read())
        return triples.find(lists, self.blocks.read_for(lists))


def parts_for(rows: int) -> int:
    """Partitions for an index of so many documents or facts: about 20,000 in each, at least PARTS and at most 4,096."""
    return max(PARTS, min(4096, rows // 20_000))


def once(saved: SavedIndex | SavedTriples, make: Callable[[], tuple[DataFrame, ...]]) -> SavedIndex | SavedTriples:
    """What is saved, made if it isn't there."""
    if not saved.exists():
        saved.create(*make())
    return saved
