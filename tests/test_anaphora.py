"""Labels and salience: what each term of the weight decides."""

import pytest
from pyspark.sql import functions as F

from lorebase import schema
from lorebase.operators import anaphora
from lorebase.operators.annotate import annotate_tokens, label


def labelled(spark, text):
    rows = spark.createDataFrame([(text.split(),)], "w array<string>").select(label(annotate_tokens(F.col("w"))).alias("t")).first().t
    return [(t["text"], t["tag"], t["dep"]) for t in rows]


def test_labels(spark):
    assert labelled(spark, "the cat was at the old house") == [("the", "DET", ""), ("cat", "NN", "nsubj"), ("was", "VBD", ""), ("at", "IN", ""), ("the", "DET", ""), ("old", "NN", ""), ("house", "NN", "pobj")]
    assert [d for *_, d in labelled(spark, "in town Peter watched stars")] == ["", "", "pobj", "", "dobj"]
    assert labelled(spark, "") == []


def token(k, text, tag, dep=""):
    return (k, [], tag, text, dep, -1, "")


@pytest.mark.parametrize(
    ("first", "second", "wins"),
    [
        ([("a", "NN", ""), ("b", "NN", "")], [], "a"),  # equal weights: the earliest
        ([("a", "NN", ""), ("b", "NN", "nsubj")], [], "b"),
        ([("a", "NN", "pobj"), ("b", "NN", "dobj")], [], "b"),
        ([("a", "NN", ""), ("b", "NN", "pobj")], [], "b"),
        ([("a", "NN", "dobj"), ("there", "EX", ""), ("b", "NN", "")], [], "b"),
        ([("a", "NN", "nsubj"), ("in", "IN", ""), ("b", "NN", "nsubj")], [], "b"),  # adverbial
        ([("in", "IN", ""), ("is", "VBZ", ""), ("a", "NN", "nsubj"), ("b", "NN", "nsubj"), ("the", "DET", ""), ("is", "VBZ", "")], [], "a"),  # both are heads
        ([("a", "NN", "nsubj"), ("is", "VBZ", ""), ("b", "NN", "nsubj"), ("the", "DET", "")], [], "b"),  # only b has a determiner before the next verb
        ([("a", "NN", "nsubj")], [("b", "NN", "")], "b"),  # 180 halved by a sentence is less than 100
        ([("there", "EX", ""), ("a", "NN", "nsubj")], [("b", "NN", "")], "a"),  # 250 halved is more
    ],
)
def test_what_decides(spark, first, second, wins):
    two = [*second, ("it", "PRP", "")] if second else [("it", "PRP", "")]
    rows = [("d", n, [token(k, *t) for k, t in enumerate(x)]) for n, x in enumerate([first, two])]
    got = anaphora.resolve(spark.createDataFrame(rows, f"doc_id string, sentence_no int, tokenList array<{schema.TOKEN}>")).collect()
    assert [r.anaphora for r in got] == [wins]


def test_far_and_missing_sentences(spark):
    noun, it = [token(0, "cat", "NN", "nsubj")], [token(0, "it", "PRP")]
    rows = [("d", 0, noun), ("d", 4, it), ("d", 5, it), ("e", 7, it), ("e", 8, []), (None, 1, noun), (None, 2, it)]
    got = {(r.doc_id, r.sentence_no): r.anaphora for r in anaphora.resolve(spark.createDataFrame(rows, f"doc_id string, sentence_no int, tokenList array<{schema.TOKEN}>")).collect()}
    assert got == {("d", 4): "cat", ("d", 5): "?", ("e", 7): "?", (None, 2): "cat"}
