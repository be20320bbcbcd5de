"""Chat formatting: tool calls linked with their results, in topological order, validated and serialised as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
WHOLE = 10_000  #: calls and dependencies of a conversation that is ordered in one pass
KEPT = 16  #: rounds after which what is done is written once


def faults(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema: type, enum, required, properties, additionalProperties, items, minLength, maxLength, minimum, maximum."""
    kind = schema.get("type")
    if kind and (not isinstance(value, KINDS[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return [f"{at}: not of type {kind}"]
    out = [f"{at}: not one of enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [x for k, v in enumerate(value) for x in faults(v, schema["items"], f"{at}[{k}]")]
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: too small"] if value < schema.get("minimum", value) else []
        out += [f"{at}: too large"] if value > schema.get("maximum", value) else []
    return out


def canonical(value: object) -> str:
    """JSON with sorted keys and without white space. Numbers that aren't finite, and surrogates without their other half, are ValueErrors."""
    out = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    out.encode()
    return out


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parsed(text: str) -> object:
    """The value of a JSON text that canonical() can write again; else a ValueError or RecursionError."""
    value = json.loads(text, parse_constant=_no_number)
    canonical(value)
    return value


def _levels_of(held: list[dict]) -> list[tuple[str, int]]:
    """call_id, level of the calls of one conversation."""
    needs: dict[str, set[str]] = {}
    for r in held:
        needs.setdefault(r["call_id"], set()).update(x for x in r["depends_on"] if x is not None)
    behind: dict[str, list[str]] = {}
    for call, own in needs.items():
        own.intersection_update(needs)
        for x in own:
            behind.setdefault(x, []).append(call)
    level = {call: 0 for call, own in needs.items() if not own}
    ready = list(level)
    for call in ready:  # grows as calls are released
        for x in behind.get(call, []):
            needs[x].discard(call)
            if not needs[x]:
                level[x] = level[call] + 1
                ready.append(x)
    return list(level.items())


def _levels_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for conv, held in zip(batch.column("conv_id").to_pylist(), batch.column("held").to_pylist(), strict=True):
            made = _levels_of(held)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(made), pa.int64()), pa.array([c for c, _ in made], pa.string()), pa.array([n for _, n in made], pa.int32())], ["conv_id", "call_id", "level"])


def _levels_by_rounds(calls: DataFrame) -> DataFrame:
    """Each round releases the calls whose dependencies all have levels; as many rounds as the longest chain has calls."""
    key = ["conv_id", "call_id"]
    edges = calls.select(*key, F.explode("depends_on").alias("needs")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("needs")).distinct()
    edges = cut(edges.join(known, ["conv_id", "needs"]))
    done = cut(calls.select(*key).distinct().join(edges.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0)))
    fresh, rounds = done, 0
    waiting = edges.groupBy(*key).agg(F.count("*").alias("left"), F.lit(0).alias("level"))
    while True:
        told = edges.join(fresh.select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("below")), ["conv_id", "needs"])
        told = told.groupBy(*key).agg(F.count("*").alias("met"), F.max("below").alias("below"))
        joined = waiting.join(told, key, "left")
        left = F.col("left") - F.coalesce("met", F.lit(0))
        waiting = cut(joined.select(*key, left.alias("left"), F.greatest("level", F.coalesce(F.col("below") + 1, F.lit(0))).alias("level")))
        fresh = waiting.where("left = 0").select(*key, "level")
        if fresh.isEmpty():
            return done
        waiting, rounds = waiting.where("left > 0"), rounds + 1
        done = done.union(fresh)
        if rounds % KEPT == 0:
            done = cut(done)


def levels(calls: DataFrame, whole: int = WHOLE) -> DataFrame:
    """calls (conv_id, call_id, depends_on) -> conv_id, call_id, level: 0 without dependencies, else one more than the highest of them.

    Calls on a cycle, or behind one, get no row, nor do calls without a conversation. Dependencies on unknown calls don't hold a call back. Conversations of at most
    `whole` calls and dependencies are ordered in one pass, each in a row of its own; larger ones, which no task should hold, in rounds over all of them, with the same outcome.
    """
    rows = cut(calls.where("conv_id is not null").select(F.col("conv_id").cast("long"), "call_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")))
    large = rows.groupBy("conv_id").agg(F.sum(F.size("depends_on") + 1).alias("n")).where(F.col("n") > whole).select("conv_id")
    some = not large.isEmpty()
    small = rows.join(large, "conv_id", "left_anti") if some else rows
    made = small.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "depends_on")).alias("held")).mapInArrow(_levels_within, "conv_id long, call_id string, level int")
    return made.unionByName(_levels_by_rounds(rows.join(large, "conv_id", "left_semi"))) if some else made


def _numbered(rows: DataFrame, more: list[str]) -> DataFrame:
    """rows (conv_id, turn, call_id and `more`) with first: whether it is the one row of its conversation and identifier that comes first by turn and `more`."""
    key, order = ["conv_id", "call_id"], ["turn", *more]
    counted = rows.groupBy(*key, *order).agg(F.count("*").alias("times"))
    usable = counted.where("conv_id is not null and call_id is not null and turn is not null")
    least = usable.groupBy(*key).agg(F.min(F.struct(*order)).alias("least"))
    joined = counted.join(least, key, "left")
    here = F.coalesce(F.struct(*order).eqNullSafe(F.col("least")), F.lit(False))
    each = joined.withColumn("first", here).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select(*rows.columns, (F.col("first") & (F.col("k") == 1)).alias("first"))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link calls (conv_id, turn, call_id, name, arguments, depends_on) with results (conv_id, call_id, turn, content) by conversation and identifier.

    A row for each call, and for each result without one: conv_id, turn, call_id, name, level (its topological place; null on or behind a cycle), linked, valid,
    fault, message (canonical JSON). Reading a conversation's rows by (level, turn) puts each call behind what it depends on.

    If an identifier is used twice, the call with the least turn has it, and the result with the least turn is its result; within a turn the least content, or the
    least name, arguments and dependencies, and of equal rows one. The others have their rows, not linked. Null
    identifiers link with nothing. Arguments that aren't JSON (NaN, numbers beyond a double and lone surrogates aren't), or break the schema of their name, or have no schema, are not valid and stand in the message as
    a string. Extra columns are ignored; empty tables give an empty result.
    """
    key = ["conv_id", "call_id"]
    calls = _numbered(calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on"), ["name", "arguments", "depends_on"])
    results = _numbered(results.select("conv_id", "turn", "call_id", "content"), ["content"])
    place = levels(calls.where("call_id is not null").select(*key, F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")))
    taken = calls.where("first").select(*key)
    got = results.where("first").select(*key, F.struct("content").alias("got")).join(taken, key, "left_semi")
    own = calls.join(place, key, "left").join(got, key, "left")
    own = own.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on", F.when(F.col("first"), F.col("level")).alias("level"), (F.col("first") & F.col("got").isNotNull()).alias("linked"), F.when(F.col("first"), F.col("got.content")).alias("content"))
    orphans = results.where("not first").unionByName(results.where("first").join(taken, key, "left_anti"))
    blank = F.lit(None).cast("string")
    both = own.unionByName(orphans.select("conv_id", "turn", "call_id", blank.alias("name"), blank.alias("arguments"), F.lit(None).cast("array<string>").alias("depends_on"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), "content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    value = parsed(r["arguments"]) if r["arguments"] is not None else None
                    found = faults(value, schemas[r["name"]]) if r["name"] in schemas else ["$: no schema"]
                except (ValueError, RecursionError):
                    value, found = None, ["$: not JSON"]
                message = {"arguments": r["arguments"] if found else value, "depends_on": sorted(r["depends_on"] or [], key=lambda x: (x is not None, x)), "id": r["call_id"], "name": r["name"], "result": r["content"]}
                rows.append((bool(r["linked"]), not found, found[0] if found else None, canonical(message)))
            linked_, valid, fault, message = zip(*rows, strict=True) if rows else [()] * 4
            made = [pa.array(linked_, pa.bool_()), pa.array(valid, pa.bool_()), pa.array(fault, pa.string()), pa.array(message, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "call_id", "name", "level")), *made], ["conv_id", "turn", "call_id", "name", "level", "linked", "valid", "fault", "message"])

    schema = "conv_id long, turn long, call_id string, name string, level int, linked boolean, valid boolean, fault string, message string"
    return both.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "call_id", "name", "arguments", "depends_on", F.col("level").cast("int"), "linked", "content").mapInArrow(write, schema)
