"""Tool-call linking against a plain reading of its rules."""

import json
import random

import pytest

from lorebase.llm import tool_calls
from lorebase.llm.queries import SCHEMAS, op7_tool_calls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, extra string"
RESULTS = "conv_id long, turn long, call_id string, content string, name string"
SCHEMA = {"f": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0, "maximum": 9}, "s": {"type": "string", "minLength": 2, "maxLength": 3, "enum": ["ab", "abc"]}, "l": {"type": "array", "items": {"type": "boolean"}}}, "additionalProperties": False}}


@pytest.mark.parametrize(
    ("arguments", "good"),
    [('{"n":1}', True), ('{"n":true}', False), ('{"n":1.5}', False), ("{}", False), ('{"n":10}', False), ('{"n":-1}', False), ('{"n":1,"s":"ab"}', True), ('{"n":1,"s":"x"}', False), ('{"n":1,"l":[true,false]}', True), ('{"n":1,"l":[1]}', False), ('{"n":1,"z":1}', False), ("[]", False)],
)
def test_schemas(arguments, good):
    assert (not tool_calls.faults(json.loads(arguments), SCHEMA["f"])) is good


def test_links_and_order(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "f", '{"n": 1,\n "s":"ab"}', [], "x"),
            (1, 2, "b", "f", '{"n":2}', ["a", "zzz"], "x"),
            (1, 4, "c", "f", '{"n":3}', ["b", "a"], "x"),
            (1, 6, "c", "f", '{"n":4}', [], "x"),  # the identifier again
            (1, 8, "p", "f", "not json", ["q"], "x"),  # a cycle
            (1, 9, "q", "f", None, ["p"], "x"),
            (1, 10, "r", "g", "{}", ["q"], "x"),  # behind it, and without a schema
            (1, 11, None, "f", '{"n":1}', None, "x"),
            (2, 0, "a", "f", '{"n":5}', None, None),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, 1, "a", "ok é\n", "x"), (1, 3, "a", "again", "x"), (1, 5, "nobody", "lost", "x"), (1, 12, None, "none", "x")], RESULTS)
    rows = tool_calls.linked(calls, results, SCHEMA).collect()
    got = {(r.conv_id, r.turn): (r.level, r.linked, r.valid) for r in rows}
    assert got == {
        (1, 0): (0, True, True), (1, 2): (1, False, True), (1, 4): (2, False, True), (1, 6): (None, False, True), (1, 8): (None, False, False), (1, 9): (None, False, False),
        (1, 10): (None, False, False), (1, 11): (None, False, True), (2, 0): (0, False, True), (1, 3): (None, False, False), (1, 5): (None, False, False), (1, 12): (None, False, False),
    }
    first = next(r for r in rows if (r.conv_id, r.turn) == (1, 0))
    assert first.message == '{"arguments":{"n":1,"s":"ab"},"depends_on":[],"id":"a","name":"f","result":"ok é\\n"}'
    assert tool_calls.linked(calls.limit(0), results.limit(0), SCHEMA).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    want = {}
    for (conv, turn), r in turns.items():
        if r.role == "user":
            level, t = 0, turn
            while t > 0 and (half := turns.get((conv, t // 2))) and half.role == "user" and t != t // 2:
                level, t = level + 1, t // 2
            answer = turns.get((conv, turn + 1))
            answer = answer.text if answer and answer.role == "assistant" else None
            value = {"text": r.text, "n_chars": len(r.text)}
            good = not tool_calls.faults(value, SCHEMAS["ask"])
            want[conv, turn] = level, answer is not None, good, answer
        elif r.role == "assistant" and (conv, turn - 1) not in {k for k, x in turns.items() if x.role == "user"}:
            want[conv, turn] = None, False, False, r.text
    got = {(r.conv_id, r.turn): (r.level, r.linked, r.valid, json.loads(r.message)["result"]) for r in op7_tool_calls(spark, sf_dir).collect()}
    assert got == want


def test_ties_of_results_and_calls_keep_their_rows(spark):
    calls = spark.createDataFrame([(1, 0, "a", "x", None, None), (1, 0, "a", "y", None, None)], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", 1, "p"), (1, "a", 1, "q"), (1, "a", 1, "p"), (1, "b", 2, "z")], "conv_id long, call_id string, turn long, content string")
    got = tool_calls.linked(calls, results, {}).collect()
    assert len(got) == 5 and sum(r.linked for r in got) == 1 and sorted(r.turn for r in got) == [0, 0, 1, 1, 2]


def test_arguments_that_are_no_json(spark):
    odd = ['{"n": NaN}', '{"n": 1e999}', '{"n": -Infinity}', '"\\ud800"', "[" * 100_000, '{"n": 1', "1" * 6000, "", '{"\\udfff": 1}']
    schema = {"f": {"type": "object", "properties": {"n": {"type": "number"}}}, "g": {}}
    rows = [(k, 0, f"c{k}", name, x, [None, "b", "a"]) for k, x in enumerate(odd) for name in ("f", "g")]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = tool_calls.linked(calls, none, schema).collect()
    assert len(got) == len(rows) and all(not r.valid and r.fault == "$: not JSON" for r in got)
    assert {r.conv_id: json.loads(r.message)["arguments"] for r in got} == dict(enumerate(odd))


def test_deep_chains_and_hot_dependencies(spark):
    """A chain of calls, a call on which all others of a conversation depend, and a cycle of three with one behind it."""
    rows = [(1, k, f"c{k}", [f"c{k - 1}"] if k else []) for k in range(8)]
    rows += [(2, k, f"c{k}", ["c0", "c0"] if k else None) for k in range(200)]
    rows += [(3, k, f"c{k}", [f"c{(k + 1) % 3}"]) for k in range(3)] + [(3, 3, "c3", ["c0"]), (None, 0, "x", ["x"]), (4, 0, "self", ["self"])]
    got = tool_calls.levels(spark.createDataFrame(rows, "conv_id long, turn long, call_id string, depends_on array<string>")).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got if r.conv_id} == {**{(1, f"c{k}"): k for k in range(8)}, **{(2, f"c{k}"): min(k, 1) for k in range(200)}}


@pytest.mark.parametrize("whole", [0, 40, 10_000])
def test_levels_are_the_same_by_rounds_and_in_one_pass(spark, whole):
    """Random dependencies against a plain reading: known ones only, cycles and what is behind them left out. Conversations fall on both sides of the size in one run."""
    draw = random.Random(3)
    rows = []
    for conv in range(12):
        n = draw.randrange(1, 25)
        for k in range(n):
            back = k if conv % 3 else n  # every third conversation may have cycles
            rows.append((conv, f"c{k}", None if draw.random() < 0.2 else [draw.choice([f"c{draw.randrange(max(back, 1))}", "unknown", None]) for _ in range(draw.randrange(3))]))
    rows += [(0, "c0", ["c1"]), (None, "c0", ["c0"])]
    want = {}
    for conv in range(12):
        needs = {}
        for c, call, over in rows:
            if c == conv:
                needs.setdefault(call, set()).update(over or [])
        needs = {c: {x for x in own if x in needs} for c, own in needs.items()}
        level = {}
        for _ in needs:
            level.update({c: max((level[x] + 1 for x in own), default=0) for c, own in needs.items() if c not in level and own <= level.keys()})
        want.update({(conv, c): n for c, n in level.items()})
    got = tool_calls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>"), whole).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == want and len(got) == len(want)


def test_a_chain_of_thousands(spark):
    rows = [(1, f"c{k}", [f"c{k - 1}"] if k else []) for k in range(4000)]
    got = tool_calls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")).collect()
    assert sorted((r.level, r.call_id) for r in got) == sorted((k, f"c{k}") for k in range(4000))
