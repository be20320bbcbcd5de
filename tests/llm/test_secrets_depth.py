"""Long runs and deep nests of codes: time and memory in proportion to the text, nothing lost."""

import base64
import random
import time
import tracemalloc
import zlib

import pytest

from lorebase.llm import secrets

KEY = "AKIA" + "B" * 20
TAIL = KEY[1:]


def nests(depth):
    return {
        "percent": "%" + "25" * depth + "41" + TAIL,
        "escape": "\\u005c" + "u005c" * depth + "u0041" + TAIL,
        "mixed escapes": "\\x5c" + "u005cx5c" * (depth // 2) + "u0041" + TAIL,
        "reference": "&#38;" + "#x26;#38;" * (depth // 2) + "#65;" + TAIL,
    }


@pytest.mark.parametrize("depth", [1, 2, 3, 8, 50_000])
def test_nested_codes(depth):
    for name, text in nests(depth).items():
        tracemalloc.start()
        began = time.process_time()
        spans = secrets.find(f"see {text} there")[1]
        took, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (4, secrets.KINDS.index("access"), 4 + len(text)) in spans, name
        assert took < 10 and most < 200e6, (name, took, most)


def test_nests_of_several_depths_in_one_word():
    text = "%252541" + "K%49" + "%2525252541" + "B" * 20
    assert (0, 1, len(text)) in secrets.find(text)[1]


@pytest.mark.parametrize("text", ["%25", "%2525", "%252525 x", "%25%2", "\\u005cu005c", "&#38;#38;", "%2525zz" * 3])
def test_nests_that_end_in_nothing(text):
    assert secrets.find(text)[1] == []


def test_long_run_between_lines():
    rng = random.Random(2)
    times = []
    for size in (100_000, 400_000):
        run = base64.b64encode(rng.randbytes(size)).decode()
        began = time.process_time()
        secrets.find(f"a line\ndata:image/png;base64,{run}\nmore text")
        times.append(time.process_time() - began)
        assert len(list(secrets.WRAPPED.finditer("wide\n" + run.rstrip("=") + "\nyy"))) == 1
    assert times[1] < 10 * times[0] + 1


def test_wrapped_runs_as_before():
    raw = ("some text here " + KEY + " and more").encode()
    code = base64.b64encode(raw).decode()
    for line in ("\n", "\r\n", "\\n", "\n> "):
        text = "mail:\n\n" + line.join(code[k : k + 12] for k in range(0, len(code), 12)) + "\n"
        assert any(kind == 1 for _, kind, _ in secrets.find(text)[1])


def test_characters_on_the_edge_of_a_piece(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_BYTES", 100)
    monkeypatch.setattr(secrets, "FED", 7)
    for shift in range(4):
        inner = "x" * shift + "é日😀" * 200 + " " + KEY + " " + "日" * 90
        code = base64.b64encode(zlib.compress(inner.encode(), 0)).decode()
        texts = [t for t, *_ in secrets.layers(code) if "日" in t]
        assert texts and any(KEY in t for t in texts)
        assert sum(t.count("æ") for t in texts) == 0  # no piece was read as latin-1
