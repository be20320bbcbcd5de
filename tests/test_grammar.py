"""Entities by the state machine: merged tokens, longest runs, and a walk in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import grammar
from lorebase.operators.annotate import surface_tokens

SINGLE = """1 January 2016|25 Mar 2099|2016-04-18 15:59:07|2016-04-18 15:59:07.123|2011-01-31|2016-04-12 11:22 PM|June 1, 2001|mailto://Blair-l/customer___oneok/22.txt
http://www.peter.co.nz|www.peter.co.nz|11:23:00 AM|23:23|23:23:00.000|00:00:00 PM|00:00:00.000|23:59:59.999|713-853-5660|(713) 853-5660""".replace("\n", "|").split("|")


def merged(spark, texts):
    rows = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    made = rows.select("id", grammar.merge_tokens(surface_tokens(T.raw_tokens("text"))).alias("t")).collect()
    return {r.id: [(t.text, t.tag, t.semantic) for t in r.t] for r in made}


def test_single_patterns(spark):
    for k, tokens in merged(spark, SINGLE).items():
        assert [t[0] for t in tokens] == [SINGLE[k]] and tokens[0][1] == "CD" and "." in tokens[0][2]


def test_sentence_patterns(spark):
    one = "mailto://Blair-l/customer___oneok/22.txt,mailto://Blair-l/customer___oneok/23.txt"
    two = "My email address is peter@peter.co.nz"
    made = merged(spark, [one, two, "no entity here at all", "", "it is 5 o'clock - 12.50 % or $ 3"])
    assert [t[0] for t in made[0]] == ["mailto://Blair-l/customer___oneok/22.txt", ",", "mailto://Blair-l/customer___oneok/23.txt"]
    assert [t[0] for t in made[1]] == ["My", "email", "address", "is", "peter@peter.co.nz"] and made[1][4][2] == "email.1"
    assert [t[0] for t in made[2]] == "no entity here at all".split() and made[3] == []
    assert ("12.50", "CD", "decimal.1") in made[4]


def test_merged_tokens_keep_the_rest_of_the_first(spark):
    rows = spark.range(1).select(grammar.merge_tokens(F.transform(surface_tokens(F.array(*(F.lit(w) for w in ("on", "2011-01-31", "yes")))), lambda t, k: t.withField("dep", F.concat(F.lit("d"), k.cast("string"))))).alias("t"))
    assert [(t["text"], t["dep"], t["index"], t["tag"]) for t in rows.first().t] == [("on", "d0", 0, ""), ("2011-01-31", "d1", 1, "CD"), ("yes", "d2", 2, "")]


TOKEN = re.compile(T.TOKEN_PATTERN)


def meets(sides, word, tokens, at, inside=()):
    """All places at which an item that begins at `at` can end, straight from the rules."""
    if word.endswith("+") and len(word) > 1:
        out, fresh = set(), meets(sides, word[:-1], tokens, at, inside)
        while fresh:
            out |= fresh
            fresh = {e for f in fresh for e in meets(sides, word[:-1], tokens, f, inside)} - out
        return out
    if word in sides and word not in inside:
        right = sides[word].strip()
        if right.startswith("[") and right.endswith("]"):
            return {e for x in right[1:-1].split() for e in meets(sides, x, tokens, at, (*inside, word))}
        ends = {at}
        for x in right.split():
            ends = {e for s in ends for e in meets(sides, x, tokens, s, (*inside, word))}
        return ends
    if at >= len(tokens):
        return set()
    t = tokens[at]
    if m := re.fullmatch(r"number\.range\((\d+),(\d+)\)", word):
        good = t.isdigit() and len(t) <= 12 and int(m[1]) <= int(t) <= int(m[2])
    else:
        good = {"abc": t.isalpha(), "number": t.isdigit(), "space": t == " "}.get(word, t == word)
    return {at + 1} if good else set()


def begins_as_word(sides, word, token):
    """Whether a rule's first item names the token itself."""
    word = word.rstrip("+") if len(word) > 1 else word
    if word in sides:
        right = sides[word].strip()
        words = right[1:-1].split() if right.startswith("[") else right.split()[:1]
        return any(begins_as_word(sides, w, token) for w in words)
    return word == token and word not in ("abc", "number", "space")


def walked(rules, text):
    sides, public, _, _ = grammar.read_rules(rules)
    names = [n for n in sides if n in public]
    tokens = [" " if t.isspace() or t == "\x08" else t for t in TOKEN.findall(text)]
    out, at = [], 0
    while at < len(tokens):
        best = None
        for own in (True, False):
            found = [(max(ends), -k) for k, n in enumerate(names) if begins_as_word(sides, sides[n].split()[0] if not sides[n].startswith("[") else n, tokens[at]) == own and (ends := meets(sides, n, tokens, at))]
            if found and best is None:
                best = max(found)
        if best:
            out.append(("".join(tokens[at : best[0]]), names[-best[1]]))
        at = best[0] if best else at + 1
    return out


OWN_RULES = """
private letter = [ x y abc ]
private small = number.range(0,9)
public a.1 = x small
public a.2 = x small - number
public b.1 = letter+ : number
public c.1 = number . number
public c.2 = number.range(5,20) . number . number
public d.1 = [ x ( ] space abc
public e.1 = - number
"""


@pytest.mark.parametrize("rules", [OWN_RULES, grammar.RULES])
def test_longest_runs_against_a_walk(spark, rules):
    plain = "\n".join(x for x in rules.splitlines() if not x.startswith("modifier"))
    rng = random.Random(8)
    words = ["x", "y", "z", "7", "12", "300", "2016", "1234567890123", "-", ".", ":", " ", " ", "(", ")", "/", "@", "%", "$", "www", "http", "May", "pm", ","]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(400)] + SINGLE
    rows = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    compiled = grammar.machine(plain)
    made = rows.select("id", T.raw_tokens("text").alias("t")).select("id", "t", grammar.runs(F.col("t"), compiled).alias("r")).collect()
    got = {r.id: [("".join(r.t[x.start : x.end]), compiled.names[x.rule]) for x in r.r] for r in made}
    for k, text in enumerate(texts):
        assert got[k] == walked(plain, text), text
    # The cheap test before the fold loses nothing.
    kept = {r.id for r in rows.where(grammar.may_hold(T.raw_tokens("text"), plain)).collect()}
    assert {k for k in got if got[k]} <= kept
