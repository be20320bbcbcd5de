"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

BINS = 4096  #: of each histogram from which a median is narrowed down
TIE = 24  #: bits of a document's hash below a dimension's value, so that equal values can be split

NODES = "node int, leaves int"


def _dimensions() -> list[Column]:
    """Metadata as numbers of 31 bits at most: bytes, language, source."""
    code = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), 16)
    return [F.least(F.col("size"), F.lit((1 << 31) - 1)), code("lang"), code("source")]


def kd_leaves(rows: DataFrame, leaves: int, dimensions: int) -> DataFrame:
    """Number the leaves of rows (size, tie, d0 ..., leaf), which are all in leaf 0 so far. A node of n leaves is cut at n // 2 : n - n // 2 of its bytes until each has one.

    A cut is found by narrowing: each round histograms the bin that holds it, for all nodes of a level at once, and only the bin of each node comes to
    the driver. The driver holds one row a node, at most one for each leaf, and only such tables are broadcast; rows stay where they are and are histogrammed there.
    """
    spark = rows.sparkSession
    whole = rows.agg(*(F.min(f"d{i}").alias(f"a{i}") for i in range(dimensions)), *(F.max(f"d{i}").alias(f"b{i}") for i in range(dimensions))).first()
    if whole["a0"] is None:
        return rows
    spans = [max(1, whole[f"b{i}"] - whole[f"a{i}"]) for i in range(dimensions)]
    now = rows
    nodes = {0: leaves}
    while open_ := {k: n for k, n in nodes.items() if n > 1}:
        width = [(F.max(f"d{i}") - F.min(f"d{i}")) / spans[i] for i in range(dimensions)]
        widest = F.array_position(F.array(*width), F.array_max(F.array(*width))) - 1
        names = spark.createDataFrame(list(open_.items()), NODES)
        facts = now.join(F.broadcast(names), F.col("leaf") == F.col("node")).groupBy("node").agg(F.sum("size").alias("bytes"), F.first("leaves").alias("leaves"), widest.cast("int").alias("axis"))
        state = {r["node"]: {"axis": r["axis"], "goal": r["bytes"] * (r["leaves"] // 2) / r["leaves"], "low": 0, "wide": 1 << 31 + TIE, "before": 0} for r in facts.collect()}
        axis = {k: x["axis"] for k, x in state.items()}
        axes = spark.createDataFrame(list(axis.items()), "node int, axis int")
        value = F.coalesce(*(F.when(F.col("axis") == i, F.col(f"d{i}")) for i in range(dimensions)))
        keyed = now.join(F.broadcast(axes), F.col("leaf") == F.col("node")).select("node", "size", (F.shiftleft(value.cast("long"), TIE) + F.col("tie")).alias("place"))
        cuts: dict[int, int] = {}
        while state:
            bounds = spark.createDataFrame([(k, x["low"], x["wide"], -(-x["wide"] // BINS), float(x["goal"]), x["before"]) for k, x in state.items()], "node int, low long, wide long, step long, goal double, before long")
            inside = keyed.join(F.broadcast(bounds), "node").where((F.col("place") >= F.col("low")) & (F.col("place") - F.col("low") < F.col("wide")))
            bins = inside.groupBy("node", F.expr("(place - low) div step").alias("bin"), "low", "step", "goal", "before").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
            over = bins.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("node").orderBy("bin")))
            crossing = over.where("upto >= goal").groupBy("node").agg(F.min_by(F.struct("low", "step", "goal", "bin", "size", "n", "upto"), "bin").alias("x")).select("node", "x.*")
            for r in crossing.collect():
                node, low = r["node"], r["low"] + r["bin"] * r["step"]
                before = r["upto"] - r["size"]
                if r["n"] == 1 or r["step"] == 1:  # to the side that comes nearer to the goal
                    cuts[node] = low if r["goal"] - before < r["upto"] - r["goal"] else low + r["step"]
                    del state[node]
                else:
                    state[node] |= {"low": low, "wide": r["step"], "before": before}
        split = spark.createDataFrame([(k, axis[k], at, k + open_[k] // 2) for k, at in cuts.items()], "node int, axis int, cut long, upper int")
        at = F.shiftleft(value.cast("long"), TIE) + F.col("tie")
        kept = [F.col(c) for c in rows.columns if c != "leaf"]
        now = cut(now.join(F.broadcast(split), F.col("leaf") == F.col("node"), "left").select(*kept, F.when(at >= F.col("cut"), F.col("upper")).otherwise(F.col("leaf")).alias("leaf")))
        nodes = {k: n for k, n in nodes.items() if n == 1} | {k: n // 2 for k, n in open_.items()} | {k + n // 2: n - n // 2 for k, n in open_.items()}
    return now


def shards(docs: DataFrame, count: int | None = None, target_bytes: int = 1 << 30) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, in `count` shards, or as many as reach target_bytes.

    The law is `bytes`: sizes are as near to equal as whole documents allow, in every shard. A document's size is the UTF-8 bytes of its text and 8; a null text has none.
    Equal texts aren't held together, as one may hold a third of all bytes. Null or missing languages
    and sources count as empty strings, a null doc_id sorts first, rows that occur twice are placed twice, extra columns are ignored, an empty table gives an empty
    result. grown_shard is null, as the law isn't `key`.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *(c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")))
    tie = F.shiftrightunsigned(F.xxhash64("text_crc32", "doc_id"), 64 - TIE)
    dimensions = _dimensions()
    rows = cut(read.select("doc_id", "size", "text_crc32", tie.alias("tie"), *(x.alias(f"d{i}") for i, x in enumerate(dimensions)), F.lit(0).alias("leaf")))
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    leaves = count or max(1, -(-(total["bytes"] or 0) // target_bytes))
    placed = kd_leaves(rows, leaves, len(dimensions)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("leaf").cast("int").alias("shard"))
    slots = numbered(placed, "shard", ["doc_id", "text_crc32"], "slot", total["n"])
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
