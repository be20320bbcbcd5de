"""The triple store: dictionary-encoded tuples, posting lists in compressed blocks, and search by terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Lexicon


def vocabulary(facts: DataFrame) -> DataFrame:
    """facts (lhs, predicate, rhs: strings and arrays of words) -> id, word, is_predicate. An id is a hash, so it needs no global order and stays the same when facts are added."""
    words = facts.select(F.explode(F.concat("lhs", "rhs")).alias("word"), F.lit(False).alias("is_predicate")).union(facts.select("predicate", F.lit(True)))
    return words.select(F.lower("word").alias("word"), "is_predicate").distinct().select(F.xxhash64("word", "is_predicate").alias("id"), "word", "is_predicate")


def encode(facts: DataFrame) -> DataFrame:
    """facts (id, lhs, predicate, rhs) -> tuples of ids, by the rule of vocabulary()."""
    code = lambda w: F.xxhash64(F.lower(w), F.lit(False))
    return facts.select("id", F.transform("lhs", code).alias("lhs"), F.xxhash64(F.lower("predicate"), F.lit(True)).alias("predicate"), F.transform("rhs", code).alias("rhs"))


BLOCK_BITS = 16  #: of an id that stand in a block; the others name it


def build_blocks(tuples: DataFrame) -> DataFrame:
    """Posting lists in blocks: predicate, word, block, n, least, greatest, offsets.

    A block has the ids that agree in all but their last BLOCK_BITS bits, as rising offsets from the first that it could hold. So blocks of one number of different words can be
    intersected as they are, and the list of a frequent word is many rows of bounded size. The tuples are read once.
    """
    rows = tuples.select("predicate", "id", F.explode(F.array_distinct(F.concat("lhs", "rhs"))).alias("word")).where("id is not null")
    block, offset = F.shiftright("id", BLOCK_BITS), F.col("id").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    made = rows.groupBy("predicate", "word", block.alias("block")).agg(F.sort_array(F.collect_set(offset)).alias("offsets"))
    base = F.shiftleft("block", BLOCK_BITS)
    return made.select("predicate", "word", "block", F.size("offsets").alias("n"), (base + F.col("offsets")[0]).alias("least"), (base + F.element_at("offsets", -1)).alias("greatest"), "offsets")


def list_sizes(blocks: DataFrame) -> DataFrame:
    """predicate, word, n: how many tuples each posting list has."""
    return blocks.groupBy("predicate", "word").agg(F.sum("n").alias("n"))


def look_up(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """terms (query_id, term) -> query_id, word id, is_predicate; unknown terms are dropped."""
    return terms.select("query_id", F.lower("term").alias("word")).distinct().join(vocab, "word").select("query_id", "id", "is_predicate")


def wanted_lists(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """terms (query_id, term) and list_sizes() -> query_id, predicate, word, place: the posting lists that a query's ids must stand in, the shortest with place 1.

    A query needs exactly one predicate and one other known term; one that hasn't has no lists. Words without postings under the predicate are ignored. Ids are hashes, so
    no dictionary is read.
    """
    lower = F.lower("term")
    coded = terms.select("query_id", F.xxhash64(lower, F.lit(False)).alias("word"), F.xxhash64(lower, F.lit(True)).alias("predicate")).distinct()
    one = coded.join(sizes.select("predicate").distinct(), "predicate").groupBy("query_id").agg(F.count("*").alias("k"), F.min("predicate").alias("predicate")).where("k = 1").drop("k")
    lists = coded.select("query_id", "word").join(one, "query_id").join(sizes, ["predicate", "word"])
    return lists.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "word"))).select("query_id", "predicate", "word", "place")


def find(lists: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, id of the tuples that stand in all posting lists of a query, by wanted_lists().

    Blocks of the shortest list say which blocks can hold an answer; the others are dropped before they are met. What is left of a block is intersected from the
    shortest part on.
    """
    hits = lists.join(blocks, ["predicate", "word"])
    numbers = hits.where("place = 1").select("query_id", "block", F.col("least").alias("_from"), F.col("greatest").alias("_to"))
    near = hits.join(numbers, ["query_id", "block"]).where("least <= _to and greatest >= _from")
    wanted = lists.groupBy("query_id").agg(F.count("*").alias("wanted"))
    met = near.groupBy("query_id", "block").agg(F.sort_array(F.collect_list(F.struct("n", "word", "offsets"))).alias("parts")).join(wanted, "query_id").where("size(parts) = wanted")
    common = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["offsets"], lambda x, part: F.array_intersect(x, part["offsets"]))
    return met.select("query_id", "block", F.explode(common).alias("offset")).select("query_id", (F.shiftleft("block", BLOCK_BITS) + F.col("offset")).alias("id"))


def page(found: DataFrame, number: int, size: int) -> DataFrame:
    """One page of the ids of a query."""
    return found.orderBy("id").offset(number * size).limit(size)


def decode(tuples: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tuples of ids to words, in their order; an unknown id is an empty word. The text has a space behind each word."""
    parts = tuples.select("id", F.posexplode(F.concat("lhs", F.array("predicate"), "rhs")).alias("pos", "code"), F.size("lhs").alias("n"))
    named = parts.join(vocab.select(F.col("id").alias("code"), "word"), "code", "left").select("id", "n", "pos", F.coalesce("word", F.lit("")).alias("word"))
    whole = named.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("all"))
    words = F.col("all.word")
    return whole.select("id", F.slice(words, 1, F.col("n")).alias("lhs"), words[F.col("n")].alias("predicate"), F.slice(words, F.col("n") + 2, F.size(words)).alias("rhs"), F.concat(F.array_join(words, " "), F.lit(" ")).alias("text"))


def match_access(questions: DataFrame, templates: DataFrame, lexicon: Lexicon, strict: bool = False) -> DataFrame:
    """questions (query_id, tokens) by access templates (predicate, w5h, components, rank) -> query_id, term: the predicate and the words to search.

    A template fits if the first token is its question word and its first component (strict: each one) is among the others. Searched are nouns, verbs, adjectives,
    adverbs and numbers that are no component; the first template that leaves any is taken.
    """
    rows = questions.select("query_id", F.lower(F.col("tokens")[0]["text"]).alias("w5h"), F.posexplode(F.slice("tokens", 2, F.size("tokens"))).alias("pos", "token")).select("query_id", "w5h", "pos", "token.text", "token.tag")
    tag = F.col("tag")
    coarse = F.when(T.is_noun(tag), "n").when(T.is_verb(tag), "v").otherwise("")
    words = lexicon.with_stem(rows, "text").select("query_id", "w5h", "stem", "pos", coarse.alias("coarse"), (T.is_noun(tag) | T.is_verb(tag) | T.is_adjective(tag) | T.is_adverb(tag) | T.is_number(tag)).alias("searched"))
    joined = words.join(templates, "w5h")
    part = F.struct(F.col("stem").alias("base"), F.col("coarse").alias("tag"))
    needed = F.when(F.lit(strict), F.size("components")).otherwise(1)
    place = F.array_position("components", part)
    facts = joined.groupBy("query_id", "rank", "predicate", needed.alias("needed")).agg(
        F.size(F.collect_set(F.when((place > 0) & (place <= needed), place))).alias("met"),
        F.collect_list(F.when(F.col("searched") & (place == 0), F.struct("pos", "stem"))).alias("rest"),
    )
    fits = facts.where((F.col("met") >= F.col("needed")) & (F.size("rest") > 0))
    best = fits.groupBy("query_id").agg(F.min_by(F.struct("predicate", "rest"), "rank").alias("x"))
    return best.select("query_id", F.explode(F.concat(F.array("x.predicate"), F.col("x.rest.stem"))).alias("term"))
