"""Annotation: tokens in the form that the operators take, untagged, tagged by rules, or from a parser's reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound


# Words of closed classes with their tags. Other words are tagged by their endings.
CLOSED = {
    "DT": "the a an this that these those",
    "IN": "of in on at by for with from to into about after before under over",
    "CC": "and or but nor",
    "PRP": "i you he she it we they me him us them himself herself itself themselves",
    "PRP$": "my your his her its our their",
    "WP": "who what whom",
    "WDT": "which",
    "WRB": "when where why how",
    "MD": "can could may might must shall should will would",
    "EX": "there",
    "VBZ": "is has does",
    "VBD": "was were had did",
    "VBP": "are am have do",
    "TO": "to",
}
ENDINGS = (("VBG", "ing"), ("VBD", "ed"), ("RB", "ly"), ("NNS", "s"))


def tag_of(word: Column) -> Column:
    lower = F.lower(word)
    out = F.when(word.rlike("^[0-9]+$"), "CD").when(word.rlike(r"^[.!?]$"), ".").when(~word.rlike("^[A-Za-z]"), ":")
    for tag, words in CLOSED.items():
        out = out.when(lower.isin(words.split()), tag)
    for tag, end in ENDINGS:
        out = out.when((F.length(word) > len(end) + 2) & lower.endswith(end), tag)
    return out.when(word.rlike("^[A-Z]"), "NNP").otherwise("NN")


def _token(text: Column, place: Column, tag: Column, dep: Column) -> Column:
    return F.struct(place.alias("index"), F.array().cast("array<int>").alias("list"), tag.alias("tag"), text.alias("text"), dep.alias("dep"), F.lit(-1).alias("synid"), F.lit("").alias("semantic"))


def surface_tokens(words: Column) -> Column:
    """Words as tokens without tags."""
    return F.transform(words, lambda w, k: _token(w, k, F.lit(""), F.lit("")))


def annotate_tokens(words: Column) -> Column:
    """Words as tokens with tags by rule, the first of them as subject."""
    return F.transform(words, lambda w, k: _token(w, k, tag_of(w), F.when(k == 0, "nsubj").otherwise("")))


def label(tokens: Column) -> Column:
    """Tokens with tags, labelled by a fold that chunks them: the last noun of a run is its head, and what stands before it says its part in the sentence.

    pobj if a preposition is the nearest of prepositions, verbs and heads before it, else dobj if a verb is, else nsubj if there was no verb; other tokens have no label.
    Determiners get the tag DET, by which the test for head nouns knows them.
    """
    return bound(tokens, _labelled)


def _labelled(tokens: Column) -> Column:
    noun = lambda t: F.coalesce(t["tag"].startswith("NN"), F.lit(False))
    items = F.transform(tokens, lambda t, k: F.struct(k.alias("k"), t.alias("t"), (noun(t) & ~F.coalesce(noun(F.get(tokens, k + 1)), F.lit(False))).alias("head")))

    def step(h: Column, x: Column) -> Column:
        tag = x["t"]["tag"]
        part = F.when(~x["head"], "").when(h["prep"] > F.greatest(h["verb"], h["noun"]), "pobj").when(h["verb"] > h["noun"], "dobj").when(h["verb"] < 0, "nsubj").otherwise("")
        made = x["t"].withField("dep", part).withField("tag", F.when(tag == "DT", "DET").otherwise(tag))
        on = lambda test, old: F.when(test, x["k"]).otherwise(old)
        return F.struct(F.concat(h["out"], F.array(made)).alias("out"), on(tag.isin("IN", "TO"), h["prep"]).alias("prep"), on(tag.startswith("VB") | (tag == "MD"), h["verb"]).alias("verb"), on(x["head"], h["noun"]).alias("noun"))

    none = F.lit(-1)
    empty = F.slice(tokens, 1, 0)
    return F.aggregate(items, F.struct(empty.alias("out"), none.alias("prep"), none.alias("verb"), none.alias("noun")), step, lambda h: h["out"])
