"""Connected components by alternating large and small stars; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SMALL = 16  #: edges that are as large as a document's facts


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Hang the neighbours of each node u on the least of them: the larger ones (both=True: large star) or the smaller ones and u itself."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    sides = edges.union(turned) if both else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sides.join(least, "a")
    out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not both:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges (a, b) of longs -> (node, component), component being the least node reachable. Nodes without a link to another node don't occur.

    Null ends and loops are ignored, repeated links count once; without links the result is empty. rows: see cut.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            break
        state = found
        now = cut(_stars(_stars(now, True), False), found[0] // SMALL)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
