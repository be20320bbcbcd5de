"""Pronouns: third-person resolution by salience, and first- and second-person replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

WINDOW = 4  #: sentences that are looked back
# Pronouns with the classes that their noun may have, and whether it must be plural.
SINGULAR = {"he": "male person", "him": "male person", "himself": "male person", "his": "male person", "she": "female person", "her": "female person", "herself": "female person", "hers": "female person", "it": "other", "itself": "other", "its": "other"}
PLURAL = {"they": "male female person other", "them": "male female person other", "themselves": "male female person"}
SECOND, FIRST = ("you", "your", "yourself", "yours"), ("i", "my", "myself", "me", "mine")
WEIGHTS = {"base": 100, "existential": 70, "nsubj": 80, "dobj": 50, "pobj": 40, "adverbial": 50, "head": 80}


def marked(tokens: Column) -> Column:
    """What salience needs of each token of a sentence, by one fold from each end: pos, text, tag, dep, semantic, existential (there is an EX before it), adverbial (back to the nearest verb
    there is a preposition) and head (on to the nearest verb there is a determiner)."""
    return bound(tokens, _marked)


def _marked(tokens: Column) -> Column:
    places = F.transform(tokens, lambda t, k: F.struct(k.alias("pos"), t["tag"].alias("tag")))
    verb = lambda t, pos, old: F.when(t["tag"].startswith("VB"), pos).otherwise(old)
    on = lambda t, tag, pos, old: F.when(t["tag"] == tag, pos).otherwise(old)
    flags = F.array().cast("array<boolean>")

    def ahead(h: Column, t: Column) -> Column:
        return F.struct(on(t, "EX", F.lit(0), h["ex"]).alias("ex"), on(t, "IN", t["pos"], h["prep"]).alias("prep"), verb(t, t["pos"], h["verb"]).alias("verb"), F.concat(h["there"], F.array(h["ex"] >= 0)).alias("there"), F.concat(h["adverbial"], F.array(h["prep"] > h["verb"])).alias("adverbial"))

    def back(h: Column, t: Column) -> Column:
        # Places fall, so the nearest one ahead is the one that was seen last.
        return F.struct(on(t, "DET", t["pos"], h["det"]).alias("det"), verb(t, t["pos"], h["verb"]).alias("verb"), F.concat(h["head"], F.array(h["det"] < h["verb"])).alias("head"))

    none, far = F.lit(-1), F.lit(1 << 30)
    first = F.aggregate(places, F.struct(none.alias("ex"), none.alias("prep"), none.alias("verb"), flags.alias("there"), flags.alias("adverbial")), ahead)
    second = F.aggregate(F.reverse(places), F.struct(far.alias("det"), far.alias("verb"), flags.alias("head")), back)
    put = lambda a, b: F.transform(tokens, lambda t, k: F.struct(
        k.alias("pos"), t["text"].alias("text"), t["tag"].alias("tag"), t["dep"].alias("dep"), F.coalesce(t["semantic"], F.lit("")).alias("semantic"),
        F.get(a["there"], k).alias("existential"), F.get(a["adverbial"], k).alias("adverbial"), F.get(b["head"], F.size(tokens) - 1 - k).alias("head"),
    ))
    return bound(F.struct(first.alias("a"), second.alias("b")), lambda x: put(x["a"], x["b"]))


def salience(token: Column) -> Column:
    """The weight of a token of marked()."""
    subject = token["dep"] == "nsubj"
    parts = {"existential": token["existential"], "nsubj": subject, "dobj": token["dep"] == "dobj", "pobj": token["dep"] == "pobj", "adverbial": subject & token["adverbial"], "head": subject & token["head"]}
    total = F.lit(WEIGHTS["base"])
    for name, test in parts.items():
        total = total + F.when(test, WEIGHTS[name]).otherwise(0)
    return total


def resolve(sentences: DataFrame) -> DataFrame:
    """doc_id, sentence_no, pos, text, anaphora of every pronoun of sentences (doc_id, sentence_no, tokenList): the most salient fitting noun before it within WINDOW sentences, or "?"; ties go to
    the earliest. Sentences are numbered once within a document.

    Weights are folds inside a sentence. Only nouns and pronouns leave it; they meet in the row of their document, so one grouping of slim rows is all that is
    shuffled, and nothing if rows are dealt by document already. A pronoun looks at the WINDOW sentences before it, so a document costs in proportion to its length.
    """
    plural = F.lower("x.text").isin(*PLURAL)
    classes = F.create_map(*(F.lit(x) for pair in {**SINGULAR, **PLURAL}.items() for x in pair))
    known = lambda t: t["tag"].isin("PRP", "PRP$") & F.lower(t["text"]).isin(*SINGULAR, *PLURAL)
    seen = sentences.select("doc_id", "sentence_no", marked(F.col("tokenList")).alias("m"))
    noun = lambda t: F.struct(F.col("sentence_no").alias("sentence_no"), t["pos"].alias("pos"), t["text"].alias("text"), t["tag"].alias("tag"), t["semantic"].alias("semantic"), salience(t).alias("weight"))
    nouns = F.transform(F.filter("m", lambda t: t["tag"].startswith("NN")), noun)
    pronouns = F.transform(F.filter("m", known), lambda t: F.struct(t["pos"].alias("pos"), t["text"].alias("text")))
    slim = seen.select("doc_id", "sentence_no", nouns.alias("nouns"), pronouns.alias("pronouns"))
    # Left out while collecting: a filter would be evaluated below, together with all that it names.
    some = F.when((F.size("nouns") > 0) | (F.size("pronouns") > 0), F.struct("sentence_no", "nouns", "pronouns"))
    docs = slim.groupBy("doc_id").agg(F.sort_array(F.collect_list(some)).alias("all"))
    near = lambda k: F.flatten(F.transform(F.slice("all", F.greatest(k - WINDOW + 1, F.lit(1)), F.least(k + 1, F.lit(WINDOW + 1))), lambda y: y["nouns"]))
    each = docs.select("doc_id", F.explode(F.filter(F.transform("all", lambda x, k: F.struct(x["sentence_no"].alias("here"), x["pronouns"].alias("pronouns"), F.when(F.size(x["pronouns"]) > 0, near(k)).alias("nouns"))), lambda x: F.size(x["pronouns"]) > 0)).alias("s"))
    each = each.select("doc_id", "s.here", "s.nouns", F.explode("s.pronouns").alias("x")).withColumn("classes", F.split(classes[F.lower("x.text")], " ")).withColumn("plural", plural)

    def fits(n: Column) -> Column:
        before = (n["sentence_no"] >= F.col("here") - WINDOW) & ((n["sentence_no"] < F.col("here")) | (n["pos"] < F.col("x.pos")))
        meant = F.array_contains("classes", n["semantic"]) | (~n["semantic"].isin("male", "female", "person") & F.array_contains("classes", F.lit("other")))
        return before & meant & (~F.col("plural") | n["tag"].isin("NNS", "NNPS"))

    ranked = F.transform(F.filter("nouns", fits), lambda n: F.struct((n["weight"] * F.pow(F.lit(2.0), n["sentence_no"] - F.col("here"))).alias("weight"), (-n["sentence_no"]).alias("s"), (-n["pos"]).alias("p"), n["text"].alias("text")))
    return each.select("doc_id", F.col("here").alias("sentence_no"), F.col("x.pos").alias("pos"), F.col("x.text").alias("text"), F.coalesce(F.array_max(ranked)["text"], F.lit("?")).alias("anaphora"))


def name_persons(tokens_: Column, first: Column, second: Column) -> Column:
    """Behind each pronoun of the first or second person, the name that it stands for in brackets."""

    def named(t: Column) -> Column:
        word = F.lower(t["text"])
        name = F.when(t["tag"].isin("PRP", "PRP$") & word.isin(*SECOND), second).when(t["tag"].isin("PRP", "PRP$") & word.isin(*FIRST), first)
        new = lambda text, tag: t.withField("text", text).withField("tag", F.lit(tag))
        return F.when(name.isNotNull(), F.array(t, new(F.lit("["), "-LRB-"), new(name, "NNP"), new(F.lit("]"), "-RRB-"))).otherwise(F.array(t))

    return F.flatten(F.transform(tokens_, named))


def has_pronoun(tokens_: Column) -> Column:
    return F.exists(tokens_, lambda t: t["tag"].isin("PRP", "PRP$") & F.lower(t["text"]).isin(*SINGULAR, *PLURAL))
