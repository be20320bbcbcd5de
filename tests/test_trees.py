"""Trees of sentences against a walk node by node, and compounds against a plain reading."""

import random

import pytest
from pyspark.sql import functions as F

from lorebase import schema
from lorebase.operators import trees

TOKENS = f"id long, tokenList array<{schema.TOKEN}>"


def token(index, over, text=None, tag="NN", dep="", semantic=""):
    return (index, over, tag, f"w{index}" if text is None else text, dep, -1, semantic)


def walked(tokens):
    """In order: index and depth of the nodes, by hanging one after the other."""
    nodes = {t[0]: {"index": t[0], "over": t[1]} for t in tokens}
    root = None
    for t in tokens:
        own = nodes[t[0]]
        if not t[1]:
            root = own
            continue
        near = next((a for a in t[1] if a != t[0]), None)
        at, steps = nodes.get(near), 0
        while at is not None and at["index"] != own["index"] and steps < 99:
            side = "left" if own["index"] < at["index"] else "right"
            at, steps = at.setdefault(side, own), steps + 1
    out = []

    def visit(node, depth):
        if node:
            visit(node.get("left"), depth + 1)
            out.append((node["index"], depth))
            visit(node.get("right"), depth + 1)

    visit(root, 0)
    return out


def test_trees_are_those_of_a_walk(spark):
    draw, rows = random.Random(5), []
    for k in range(300):
        n = draw.randrange(1, 12)
        names = draw.sample(range(40), n)
        names = sorted(names) if k % 2 else names
        root = draw.choice(names)
        done, over = [root], {root: []}
        for x in draw.sample(names, n):
            if x != root:
                near = draw.choice(done)
                over[x] = ([x] if draw.random() < 0.2 else []) + [near, *over[near]]
                done.append(x)
        rows.append((k, [token(x, over[x]) for x in names]))
    made = {r.id: [(x.token["index"], x.depth) for x in r.n] for r in spark.createDataFrame(rows, TOKENS).select("id", trees.tree(F.col("tokenList")).alias("n")).collect()}
    assert made == {k: walked(t) for k, t in rows}


def test_ranges_are_subtrees(spark):
    rows = [(1, [token(0, [1]), token(1, []), token(2, [3, 1]), token(3, [1]), token(4, [1]), token(5, [6, 4, 1]), token(6, [4, 1])])]
    nodes = spark.createDataFrame(rows, TOKENS).select(trees.tree(F.col("tokenList")).alias("n"))
    got = nodes.select(*[F.transform(trees.subtree(F.col("n"), F.lit(k)), lambda t: t["index"]).alias(f"s{k}") for k in (0, 1, 3, 6, 9)]).first()
    assert list(got) == [[0], list(range(7)), [2, 3, 4, 5, 6], [5, 6], []]


SAID = [("The", [2, 3], "DT", "det", ""), ("old", [2, 3], "JJ", "amod", ""), ("baker", [3], "NN", "nsubj", "person.1"), ("sells", [], "VBZ", "ROOT", ""), ("warm", [5, 3], "JJ", "amod", ""), ("bread", [3], "NN", "dobj", ""), ("baked", [5, 3], "VBN", "acl", ""), ("today", [6, 5, 3], "RB", "advmod", ""), (".", [3], ".", "punct", "")]


def test_renderings(spark):
    nodes = spark.createDataFrame([(1, [token(k, o, w, t, d, s) for k, (w, o, t, d, s) in enumerate(SAID)])], TOKENS).select(trees.tree(F.col("tokenList")).alias("n"))
    got = nodes.select(trees.tree_by_verbs(F.col("n")).alias("v"), trees.tree_flat(F.col("n")).alias("f")).first()
    assert got.v == "_sells{VBZ}_ (The old baker{person} | warm bread{dobj} _baked{VBN}_ (today .))"
    assert got.f.startswith("[The:det] [old:amod] [baker{person}:nsubj] [sells:ROOT]") and got.f.endswith("[.:punct]")


@pytest.mark.parametrize(
    ("tokens", "wanted"),
    [
        ([], []),
        ([token(0, [1]), token(1, [0])], []),  # a circle, no root
        ([token(0, []), token(1, [2]), token(2, [1]), token(3, [9])], [0]),  # a circle aside, a parent that isn't there
        ([token(0, []), token(1, [0]), token(2, [])], [2]),  # the last root counts
        ([token(0, []), token(1, [1])], [0]),  # no other ancestor
        ([token(0, []), token(1, [0], "first"), token(1, [0], "last")], [0, 1]),
    ],
)
def test_odd_sentences(spark, tokens, wanted):
    nodes = spark.createDataFrame([(1, tokens)], TOKENS).select(trees.tree(F.col("tokenList")).alias("n")).first().n
    assert [x.token["index"] for x in nodes] == wanted
    assert all(x.token.text != "first" for x in nodes)


def test_null_tokens_and_long_sentences(spark):
    n = 20_000
    rows = spark.createDataFrame([(1, None), (2, [token(k, [0] if k else []) for k in range(n)])], TOKENS)
    got = {r.id: r.n for r in rows.select("id", F.size(trees.tree(F.col("tokenList"))).alias("n")).collect()}
    assert got[2] == n and got[1] in (None, -1)


def read_plainly(texts, known, most=5):
    out, k = [], 0
    while k < len(texts):
        n = next((n for n in range(min(most, len(texts) - k), 1, -1) if " ".join(texts[k : k + n]).lower() in known), 1)
        out.append(" ".join(texts[k : k + n]))
        k += n
    return out


def test_compounds_as_read_plainly(spark):
    draw = random.Random(7)
    known = {" ".join(draw.choice("abcd") for _ in range(draw.randrange(2, 6))) for _ in range(40)} | {"a b c d a b", "a"}
    rows = [(k % 90 if k % 10 else None, [token(i, [], draw.choice(["a", "B", "c", "d", "e", "a b"])) for i in range(draw.randrange(0, 25))]) for k in range(200)]
    made = trees.merge_longest(spark.createDataFrame(rows, TOKENS), spark.createDataFrame([(x.upper() if len(x) == 3 else x,) for x in known], "compound string"))
    got = sorted((r.id or -1, [t.text for t in r.tokenList]) for r in made.collect())
    assert got == sorted((k or -1, read_plainly([t[3] for t in tokens], known)) for k, tokens in rows)


def test_no_sentences_and_no_compounds(spark):
    none = spark.createDataFrame([], TOKENS)
    assert trees.merge_longest(none, spark.createDataFrame([("a b",)], "compound string")).count() == 0
    rows = spark.createDataFrame([(1, None), (2, [token(0, [], "a"), token(1, [], "b")])], TOKENS)
    assert trees.merge_longest(rows, spark.createDataFrame([(None,)], "compound string")).count() == 2
    assert {r.id: r.tokenList and [t.text for t in r.tokenList] for r in trees.merge_longest(rows, spark.createDataFrame([("a b",)], "compound string")).collect()} == {1: None, 2: ["a b"]}
