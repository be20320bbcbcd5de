"""Alignment of two tokenizers against brute force."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lorebase.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, pack long, copies long, lang string"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def gpt_bytes(a):
    """The bytes of each id, from the decoder of the library where it is exact, and from the table of bytes otherwise."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in printable]
    table = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    return {k: bytes(table[c] for c in t) for t, k in a.get_vocab().items() if all(c in table for c in t)}


def groups_of(a, b, text, table):
    """Groups from byte ranges: every end of both is a cut."""
    if not text:
        return []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    other = b.encode(text)
    names = [b.id_to_piece(k) for k in other]
    left = [table[k] for k in ids]
    right = [bytes([int(n[3:5], 16)]) if b.is_byte(k) else n.replace("▁", " ").encode() for k, n in zip(other, names)]
    if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
        return []
    ends_a, ends_b = ([*accumulate(map(len, parts))] for parts in (left, right))
    cuts = sorted({*ends_a} & {*ends_b})
    out = [([], []) for _ in cuts]
    for side, (own, ends) in enumerate(((ids, ends_a), (other, ends_b))):
        for k, e in zip(own, ends):
            out[bisect_left(cuts, e)][side].append(k)
    return out


def brute(rows, a, b):
    table = gpt_bytes(a)
    every = [groups_of(a, b, text, table) for _, text in rows]
    links = [Counter((x, y) for g, h in groups for x in g for y in h) for groups in every]
    count = Counter(p for own in links for p in own)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return Counter(
        (
            doc, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), own.total(), sum(n for p, n in own.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups).encode()).hexdigest() if groups else "",
        )
        for (doc, _), groups, own in zip(rows, every, links)
    )


def check(spark, rows, tokenizers, **options):
    made = alignment.aligned(spark.createDataFrame([(i, t, "x", 1, 2, None) for i, t in rows], SCHEMA), A, B, **options).collect()
    assert Counter(map(tuple, made)) == brute(rows, *tokenizers)


def odd_texts():
    rng = random.Random(4)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "é", "é", "日本語", "😀", "👩‍👩‍👧", "'s", "12345", "!!", "…", "<s>", "<|endoftext|>", "<0x41>", "ﬁ", "\x00", "\x1c", "Straße", "перевод", "﻿", "퟿"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(120)]


def test_odd_rows(spark, tokenizers):
    texts = [None, "", " ", "  ", "\n", "a▁b", "one two", "one two", " lead", "trail ", "x" * 3000, "word " * 3000, *odd_texts()]
    check(spark, [*enumerate(texts), (3, "one two"), (None, "one two"), (None, None), (3, "one two")], tokenizers)


@pytest.mark.parametrize("chunk", [1, 7, 40])
def test_ranges_of_long_documents(spark, tokenizers, chunk):
    texts = [None, "", "one two three four five six seven", "one two three four five six seven", "x" * 300, "日本語" * 30 + " and more " + "é" * 50, "bad ▁ sign " * 9, *odd_texts()[:60], "trail  ", "  lead"]
    check(spark, [*enumerate(texts), (3, texts[3]), (None, texts[3])], tokenizers, chunk=chunk)


def test_ranges_cover_the_text():
    rng = random.Random(1)
    for text in odd_texts():
        for chunk in (1, 3, 16, 1000):
            parts = list(alignment.ranges(text, chunk))
            assert sum(high - low for _, low, high in parts) == len((" " + text).encode())
            assert b"".join((" " + t).encode()[low:high] for t, low, high in parts) == (" " + text).encode()
    words = " ".join("w" * rng.randint(1, 9) for _ in range(2000))
    assert all(len(t) < 3 * 64 for t, _, _ in alignment.ranges(words, 64)) and len(list(alignment.ranges(words, 64))) > 100


def test_groups(tokenizers):
    aligner = alignment.Aligner(A, B)
    for text in odd_texts()[:40]:
        both = aligner.ids(text)
        whole = [] if both is None else list(aligner.groups(*both))
        assert whole == groups_of(*tokenizers, text, gpt_bytes(tokenizers[0]))


def test_words_are_forgotten(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 8)
    monkeypatch.setattr(alignment, "PACKED", 60)
    check(spark, list(enumerate(odd_texts()[:40] + ["a b c d e f g h i j k"] * 3)), tokenizers)


def test_empty(spark):
    made = alignment.aligned(spark.createDataFrame([], SCHEMA), A, B)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and not made.count()


def test_query_against_brute_force(spark, tokenizers):
    from lorebase.llm.queries import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = queries()["op11_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert Counter(map(tuple, made)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], *tokenizers)
