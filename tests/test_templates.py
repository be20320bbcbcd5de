"""The trie of templates against a walk in Python, and at the size of a hundred thousand templates."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from lorebase.operators import templates

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\*")


def walked(categories, text):
    """What matches, by the rules that match() states."""
    trie = {}
    for place, (pattern, _, said) in enumerate(categories):
        for form, one in enumerate(templates.expand(pattern)):
            words = TOKEN.findall(one.lower())
            if len(words) < 2 or words[0] == "*":
                continue
            node = trie
            for w in words:
                node = node.setdefault(w, {})
            node.setdefault("", []).extend((place, form, k, t) for k, t in enumerate(said))
    tokens, out = TOKEN.findall(text.lower()), []

    def emit(node, stars):
        out.extend((*t, " ".join(s for s in stars if s)) for t in node.get("", []))

    def step(node, at, stars):
        if at == len(tokens):
            emit(node if "" in node else node.get("*", {}), stars)
            return
        if tokens[at] in node:
            step(node[tokens[at]], at + 1, stars)
        if "*" in node:
            wild = node["*"]
            stop = next((k for k in range(at, len(tokens)) if tokens[k] in wild), None)
            taken = [*stars, " ".join(tokens[at:stop])]
            if stop is None:
                emit(wild, taken)
            elif stop + 1 == len(tokens):
                emit(wild[tokens[stop]], taken)
            else:
                step(wild[tokens[stop]], stop + 1, taken)

    if tokens and tokens[0] in trie:
        step(trie[tokens[0]], 1, [])
    return out


@pytest.mark.parametrize("small", [True, False])
def test_against_a_walk(spark, small):
    rng = random.Random(5 + small)
    word = lambda: rng.choice("abcd")
    categories = []
    for _ in range(60):
        parts = [rng.choice([word(), word(), "*", f"({word()}|{word()})"]) for _ in range(rng.randint(1, 5))]
        categories.append((" ".join(parts), "o", [f"t{rng.randrange(9)}" for _ in range(rng.randint(1, 2))]))
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 7))) for _ in range(300)]
    rules = templates.compile_templates(spark, categories)
    rules = templates.Rules(rules.edges, rules.templates, rules.depth, small)
    asked = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (1, None), (None, "a b")], "query_id int, text string")
    made = sorted((str(r.query_id), *r.rank, r.template, r.star) for r in templates.match(asked, rules).collect())
    wanted = sorted({(str(k), t, x) for k, t in [*enumerate(texts), (None, "a b")] for x in walked(categories, t)})
    assert made == sorted((k, *x) for k, _, x in wanted) and len(made) > 200


def test_many_stars(spark):
    plain = "go * a * b * c * d * e * f * g * h * i * j"
    asked = "go " + " ".join(f"{n} {x}" for n, x in zip("one two three four five six seven eight nine ten".split(), "abcdefghij"))
    found = templates.match(spark.createDataFrame([(1, asked)], "query_id int, text string"), templates.compile_templates(spark, [(plain, "o", ["t"])])).collect()
    assert [r.star for r in found] == ["one two three four five six seven eight nine ten"]


def test_no_rules_and_no_questions(spark):
    none = templates.compile_templates(spark, [("* a", "o", ["t"]), ("one", "o", ["t"])])
    asked = spark.createDataFrame([(1, "a b")], "query_id int, text string")
    assert none.depth == 0 and templates.match(asked, none).count() == 0
    assert templates.match(asked.limit(0), templates.compile_templates(spark, [("a b", "o", ["t"])])).count() == 0


def test_a_hundred_thousand_templates(spark):
    """All rules are in one plan, which deals the questions once."""
    rows = spark.range(100_000).select(F.col("id").alias("place"), F.format_string("say %s now *", F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("pattern"), F.lit("o").alias("origin"), F.array(F.col("id").cast("string")).alias("templates"))
    rules = templates.compile_rules(rows)
    assert rules.small and rules.depth == 4
    asked = spark.createDataFrame([(1, "say bcd now or never"), (2, "say jjjjj now"), (3, "say bcd then"), (4, "say zz now")], "query_id int, text string")
    found = templates.match(asked, rules)
    assert {(r.query_id, r.template, r.star) for r in found.collect()} == {(1, "123", "or never"), (2, "99999", "")}
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found.explain("formatted")
    assert "CartesianProduct" not in out.getvalue() and "NestedLoop" not in out.getvalue()
