"""The parity join against brute force."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lorebase.llm import parity_join
from lorebase.llm.common import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, component_id string, n long, key string"


def grams(text, size=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size=3, percent=90):
    """component_id by doc_id; a doc_id is linked by any of its texts."""
    least = {i: i for i, _ in rows if i is not None}
    sets = [(i, grams(t, size)) for i, t in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                moved = True
    return least


def check(spark, rows, **options):
    made = parity_join.jaccard_components(spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA), **options).collect()
    least = brute(rows, options.get("words", 3), options.get("percent", 90))
    wanted = Counter((i, len(grams(t, options.get("words", 3))), least.get(i)) for i, t in rows)
    assert Counter(map(tuple, made)) == wanted


@pytest.mark.parametrize("percent", [60, 75, 90, 97])
def test_links_share_a_part(percent):
    """Sets that differ as much as a link allows, over all sizes, in the least favourable way: one holds the other, or both have members of their own."""
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), *rng.integers(60, 3000, 60)]:
        pool = mix(rng.integers(0, 2**63, 2 * size + 10).astype(np.uint64))
        apart = parity_join.most_apart(int(size), percent)
        for own in {0, apart // 2, apart}:
            a = np.sort(pool[:size])
            b = np.sort(np.concatenate([pool[own:size], pool[size : size + apart - own]]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                assert len(np.intersect1d(parity_join.part_keys(a, percent), parity_join.part_keys(b, percent)))


def test_bands():
    for percent in (75, 90):
        for a in range(1, 400):
            for b in range(a, a * 100 // percent + 1):
                assert parity_join.bands_of(a, percent)[-1] in parity_join.bands_of(b, percent)


def edited(words, rng, edits):
    words = list(words)
    for k in rng.choice(len(words), edits, replace=False):
        words[k] = f"e{rng.integers(10**9)}"
    return " ".join(words)


def test_groups_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for group in range(12):
        size = int(rng.choice([3, 4, 8, 11, 12, 30, 100, 400]))
        base = [f"w{rng.integers(10**6)}" for _ in range(size)]
        for _ in range(int(rng.integers(2, 9))):
            rows.append((len(rows) * 7 % 1009, edited(base, rng, int(rng.integers(0, 1 + size // 40)))))
        rows.append((5000 + group, " ".join(base[: size - size // 15])))
    rows += [(2000, rows[0][1]), (2001, rows[0][1].upper())]
    check(spark, rows)
    check(spark, rows, words=2, percent=60)


def test_chain_reaches_the_least(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(50 - k, " ".join(words[3 * k : 3 * k + 200])) for k in range(20)]
    check(spark, rows)


def test_odd_rows(spark):
    long = "long " * 30000 + " ".join(f"x{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "a b c"), (8, "A\tB\nc"), (9, long), (10, long + " tail"), (None, "a b c"), (None, None), (11, "É a b"), (12, "é a b")]
    check(spark, rows)


def test_repeated_ids(spark):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, one), (5, two), (5, two), (3, two + " end"), (9, one + " end"), (9, one + " end"), (8, "else where now")]
    check(spark, rows)


def test_one_group_of_many(spark):
    """Every document is an exact or near copy of one text."""
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base) if k % 3 else edited(base, rng, 1)) for k in range(300)]
    check(spark, rows)


def test_empty(spark):
    made = parity_join.jaccard_components(spark.createDataFrame([], SCHEMA))
    assert made.columns == ["doc_id", "n_shingles", "component_id"] and not made.count()
    check(spark, [(1, None), (2, "")])
