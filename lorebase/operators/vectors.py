"""Word vectors: similarity, neighbours by buckets of their norms, and the nearest of all by clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def similarity(a: Column, b: Column) -> Column:
    """The hyperbolic cosine of the cosine: 1 for right angles, 1.543 for equal or opposite directions."""
    return F.cosh(cosine(a, b))


def bucket(vector: Column, size: int) -> Column:
    """Bucket by norm; null from `size` on, where vectors aren't indexed."""
    place = F.floor(norm(vector) / F.size(vector) * size).cast("long")
    return F.when(place < size, place)


def _scores(own: pa.Table, wanted: pa.Table) -> pa.Table:
    """The scores of all vectors of a block for all queries of a tile, some queries at a time; null where lengths differ."""
    made = [pa.table({"query_id": wanted["query_id"].slice(0, 0), "text": own["text"].slice(0, 0), "score": pa.array([], pa.float64())})]
    lengths = [np.asarray(pc.list_value_length(x["vector"])) for x in (own, wanted)]
    for n in np.unique(lengths[0]):
        rows = own.filter(pa.array(lengths[0] == n))
        x = _matrix(rows, "vector", n)
        for m in np.unique(lengths[1]):
            asked = wanted.filter(pa.array(lengths[1] == m))
            w = _matrix(asked, "vector", m)
            for k in range(0, len(w), 64):
                some = w[k : k + 64]
                score = None
                if n == m:
                    with np.errstate(invalid="ignore", divide="ignore"):
                        score = some @ x.T / np.outer(np.sqrt(np.sum(some * some, axis=1)), np.sqrt(np.sum(x * x, axis=1)))
                    score = np.floor(np.cosh(score) * 1e6 + 0.5).reshape(-1) / 1e6
                times = pa.array(np.repeat(np.arange(k, k + len(some)), len(x)))
                made.append(pa.table({"query_id": asked["query_id"].take(times), "text": pa.chunked_array(rows["text"].chunks * len(some), rows["text"].type), "score": pa.nulls(len(times), pa.float64()) if score is None else score}))
    return pa.concat_tables(made)


def related(vectors: DataFrame, queries: DataFrame, buckets: int, distance: int, block: int = 4096, tile: int = 1024) -> DataFrame:
    """queries (query_id, vector) against vectors (text, vector) in buckets at most `distance` away: query_id, text, score, itself included.

    A bucket of any size is dealt over blocks of about `block` vectors, and the queries that look into it over tiles of about `tile`; each block meets each tile in a group of its own.
    The driver sees nothing, all executors see one row for each bucket.
    """
    near = queries.withColumn("bucket", bucket(F.col("vector"), buckets)).where("bucket is not null")
    near = near.select(F.col("query_id").alias("query_id"), F.col("vector").alias("wanted"), F.explode(F.sequence(F.col("bucket") - distance, F.col("bucket") + distance)).alias("bucket"))
    indexed = vectors.select(F.col("text").alias("text"), F.col("vector").alias("vector"), bucket(F.col("vector"), buckets).alias("bucket")).where("bucket is not null")
    parts = lambda rows, size, name: rows.groupBy("bucket").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(parts(indexed, block, "blocks").join(parts(near, tile, "tiles"), "bucket"))
    dealt = lambda name, vector, n: F.pmod(F.xxhash64(name, vector), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = indexed.join(sizes, "bucket").select("text", "vector", "bucket", dealt("text", "vector", "blocks").alias("block"), every("tiles").alias("tile"))
    asked = near.join(sizes, "bucket").select("query_id", F.col("wanted").alias("vector"), "bucket", every("blocks").alias("block"), dealt("query_id", "wanted", "tiles").alias("tile"))
    text, query = dict(vectors.dtypes)["text"], dict(queries.dtypes)["query_id"]
    place = ["bucket", "block", "tile"]
    return own.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(_scores, f"query_id {query}, text {text}, score double")


@dataclass(frozen=True)
class Clusters:
    """Unit heads, and of each cluster the greatest angle of a vector's line to the head's and the count of vectors."""

    heads: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.minimum(np.abs(vectors @ self.heads.T), 1))

    def best(self, angles: np.ndarray) -> np.ndarray:
        """The highest score that a vector of each cluster can have, if the query's line stands at these angles to the heads: angles of lines keep the triangle inequality."""
        return np.cosh(np.cos(np.maximum(angles - self.radius - 1e-9, 0)))


def _matrix(batch: pa.RecordBatch | pa.Table, column: str, length: int) -> np.ndarray:
    flat = batch.column(column)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten(), np.float64).reshape(-1, length)


def _units(batch: pa.RecordBatch | pa.Table, column: str, length: int) -> np.ndarray:
    made = _matrix(batch, column, length)
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def _spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Heads among the sample, each as far as can be from those before it."""
    heads, near = [0], np.abs(sample @ sample[0])
    while len(heads) < min(most, len(sample)) and near.min() < 1 - 1e-9:
        heads.append(int(near.argmin()))
        near = np.maximum(near, np.abs(sample @ sample[heads[-1]]))
    return sample[heads]


def nearest(vectors: DataFrame, queries: DataFrame, n: int, heads: int = 64, sample: int = 4096, block: int = 4096) -> DataFrame:
    """The n nearest of all vectors (text, vector) for each of queries (query_id, vector): query_id, text, score; by score, ties by text. Exact.

    Vectors belong to the nearest of at most `heads` heads, which come from a bounded sample. A query looks first into the clusters next to it that hold n vectors; the worst score
    found there says which other clusters can hold a better one, by the triangle inequality of angles, and only these are looked into. A cluster is dealt over blocks of
    about `block` vectors, each of which keeps its own n for a query, so a hot cluster is many tasks. Left out: vectors and queries that are null, empty or zero, hold null or
    non-finite entries, or have another length than most vectors.
    """
    spark = vectors.sparkSession
    fit = "size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    rows, asked = (x.select(name, F.col("vector").cast("array<double>").alias("vector")).where(fit) for x, name in ((vectors, "text"), (queries, "query_id")))
    text, query = dict(rows.dtypes)["text"], dict(asked.dtypes)["query_id"]
    schema = f"query_id {query}, text {text}, score double"
    usual = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if not usual:
        return spark.createDataFrame([], schema)
    length = usual["length"]
    rows, asked = rows.where(F.size("vector") == length), asked.where(F.size("vector") == length)
    seen = np.array([r[0] for r in rows.select("vector").orderBy(F.xxhash64("text"), "vector").limit(sample).collect()])
    units = _spread(seen / np.linalg.norm(seen, axis=1, keepdims=True), heads)
    bare = Clusters(units, np.zeros(len(units)), np.zeros(len(units), int))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = bare.angles(_units(batch, "vector", length))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles.argmin(axis=1).astype(np.int32)), pa.array(angles.min(axis=1))], ["text", "vector", "cluster", "angle"])

    placed = rows.mapInArrow(place, f"text {text}, vector array<double>, cluster int, angle double")
    radius, count = np.zeros(len(units)), np.zeros(len(units), int)
    for k, r, c in placed.groupBy("cluster").agg(F.max("angle"), F.count("*")).collect():
        radius[k], count[k] = r, c
    clusters, blocks = Clusters(units, radius, count), np.maximum(1, -(-count // block))

    def choose(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        """Each query with the blocks it looks into: those of the next clusters with n vectors, or, once it has a worst score, of the others that can hold a better one."""
        for batch in batches:
            angles = clusters.angles(_units(batch, "vector", length))
            order = angles.argsort(axis=1, kind="stable")
            before = np.cumsum(count[order], axis=1) - count[order]
            first = np.zeros_like(angles, bool)
            np.put_along_axis(first, order, before < n, axis=1)
            if again:
                worst = batch.column("worst").to_numpy(zero_copy_only=False)[:, None]
                first = ~first & (np.isnan(worst) | (clusters.best(angles) >= worst - 2e-6))
            at, cluster = np.nonzero(first & (count > 0))
            times = blocks[cluster]
            block_no = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(np.repeat(at, times))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("vector").take(take), pa.array(np.repeat(cluster, times).astype(np.int32)), pa.array(block_no.astype(np.int32))], ["query_id", "vector", "cluster", "block"])

    def look(own: pa.Table, wanted: pa.Table) -> pa.Table:
        """The n best of a block for each query that looks into it; rows in order of their text, so that a stable sort settles ties."""
        own = own.sort_by("text")
        made = [pa.table({"query_id": wanted["query_id"].slice(0, 0), "text": own["text"].slice(0, 0), "score": pa.array([], pa.float64())})]
        if own.num_rows and wanted.num_rows:
            x, w = _units(own, "vector", length), _units(wanted, "vector", length)
            for k in range(0, len(w), 256):
                score = np.floor(np.cosh(w[k : k + 256] @ x.T) * 1e6 + 0.5) / 1e6
                best = np.argsort(-score, axis=1, kind="stable")[:, :n]
                ids = pa.array(np.repeat(np.arange(k, k + len(score)), best.shape[1]))
                made.append(pa.table({"query_id": wanted["query_id"].take(ids), "text": own["text"].take(pa.array(best.reshape(-1))), "score": np.take_along_axis(score, best, 1).reshape(-1)}))
        return pa.concat_tables(made)

    number = F.pmod(F.xxhash64("text"), F.get(F.split(F.lit(",".join(map(str, blocks))), ",").cast("array<int>"), F.col("cluster"))).cast("int")
    dealt = placed.select("text", "vector", F.col("cluster").alias("own"), number.alias("part")).groupBy("own", "part")

    def found(wanted: DataFrame, again: bool) -> DataFrame:
        pairs = wanted.mapInArrow(lambda batches: choose(batches, again), f"query_id {query}, vector array<double>, cluster int, block int")
        return dealt.cogroup(pairs.groupBy("cluster", "block")).applyInArrow(look, schema)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "text")
    kept = lambda scored: scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    near = kept(found(asked, False))
    worst = near.groupBy("query_id").agg(F.max(F.when(F.col("place") == n, F.col("score"))).alias("worst"))
    more = found(asked.join(worst, "query_id", "left"), True)
    return kept(near.drop("place").unionByName(more)).drop("place")


def top(scored: DataFrame, n: int) -> DataFrame:
    """The n nearest of one query: by score, ties by text."""
    return scored.orderBy(F.desc("score"), "text").limit(n)
