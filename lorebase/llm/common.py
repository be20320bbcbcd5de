"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


FEW = 10_000  #: rows of a table of groups that are broadcast; more are joined in salted parts
SALTS = 32  #: parts of a hot group, so that no task meets a whole one
FILE_ROWS = 10_000  #: rows, as large as a document's facts, of a file that is cut where the number of rows is known


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Compute df once into the shared checkpoint folder, so that a lost executor costs a read and not a recomputation.

    A checkpoint has a file for each partition, empty ones too, and on a local file system Hadoop starts two processes for each file. Where `rows` says how many rows
    to expect, no more partitions are written than these fill at FILE_ROWS each, all of df in any case. The folder is spark.checkpoint.dir. Where that is unset a local session takes one of its own; a cluster must name one that all its machines share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        context.setCheckpointDir(folder)
    return (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint(eager=True)


def beside(rows: DataFrame, facts: DataFrame, by: str, few: bool, how: str = "inner") -> DataFrame:
    """rows with the facts of their group, one row a group: broadcast if `few` says that there are at most FEW groups, else joined in SALTS parts, so that a hot group
    isn't one task. `by` isn't null on either side."""
    if few:
        return rows.join(F.broadcast(facts), by, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [by, "_salt"], how).drop("_salt")


def quantiles(rows: DataFrame, by: str, value: Column, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of a value in each group: by, and under each name of `shares` the least value that this share of the rows doesn't exceed.

    Equal values are counted before anything is sorted, so the value must lie on a grid. The result doesn't depend on how rows are dealt.
    """
    counted = rows.select(by, value.alias("_v")).where("_v is not null").groupBy(by, "_v").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(by)
    ranked = counted.select(by, "_v", F.sum("_n").over(own.orderBy("_v")).alias("_upto"), F.sum("_n").over(own).alias("_all"))
    return ranked.groupBy(by).agg(*(F.min(F.when(F.col("_upto") >= F.ceil(F.lit(s) * F.col("_all")), F.col("_v"))).alias(name) for name, s in shares.items()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8. bytes.split() splits at exactly these six characters; none of them occurs inside a multi-byte character."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased; bytes.lower() leaves all other bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each window of `size` words; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= STEP
        out += hashes[k : k + n]
    return mix(out)


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words than `size` the whole sequence is the one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hash_words(words), min(size, len(words))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from all values end to end and the count of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def numbered(df: DataFrame, group: str, order: list[str | Column], out: str, rows: int) -> DataFrame:
    """Add `out`: numbers gapless from 0 within each group. A hot group is cut into salts, more of them the more rows there are, which are numbered
    apart and then shifted by the counts before them, so no task sorts a whole group. `rows` is the row count of df, which must be cheap to read twice."""
    salts = 1 + int(rows**0.5) // 16
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("_group"), F.col("_salt").alias("_part"), before.alias("_start"))
    place = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order)) - 1
    placed = salted.withColumn("_place", place)
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_salt") == F.col("_part")))
    return joined.withColumn(out, (F.col("_start") + F.col("_place")).cast("long")).drop("_salt", "_group", "_part", "_start", "_place")
