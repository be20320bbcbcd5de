"""Tables that change by increments.

A table is laid out in partitions by a hash of some columns of its key, and sorted within them, so that a read for some keys opens only the files that can hold them. A
change writes a log of upserts or deletes into the partitions it touches, and nothing else; reading merges base and logs, compaction rewrites the
partitions that have logs. A commit names the folders that make up a version, so readers of an older one aren't disturbed, and of two writers of one version the
second fails.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "base array<struct<folder:string,parts:array<int>>>, logs array<string>"
LOGS = 16  #: logs after which a change compacts
DEALS = 8  #: tasks at most over which an upsert deals the rows of a partition
PACK_ROWS = 1 << 18  #: rows that a task packs at a time


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one takes a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return spark.conf.get("spark.checkpoint.dir")


@dataclass(frozen=True)
class Layout:
    schema: str
    key: list[str]  #: a row is told from others by these; null is a value like any other
    by: list[str]  #: columns of the key, by whose hash rows are laid out
    group: list[str]  #: columns of the key by which rows are deleted; they hold those of `by`
    parts: int = 64
    sort: list[str] = field(default_factory=list)  #: order within a partition, `by` first

    def part(self, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*(values or [F.col(c) for c in self.by])), F.lit(self.parts)).cast("int")


def _same(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A join in which nulls meet nulls."""
    named = right.select(*(F.col(c).alias(f"_{c}") if c in columns else F.col(c) for c in right.columns))
    test = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    return left.join(named, test, how).drop(*(f"_{c}" for c in columns))


Pack = Callable[[Layout, DataFrame], DataFrame]  #: deals rows out by `part` and gives those of the table, with it, in order


def unpacked(make: Callable[[DataFrame], DataFrame]) -> Pack:
    """A pack for rows that hold those of the table in a narrower form, one for each value of what it is laid out by; `make` makes them behind the exchange and keeps `part`."""

    def pack(layout: Layout, rows: DataFrame) -> DataFrame:
        return make(rows.withColumn("part", layout.part()).hint("rebalance", "part").sortWithinPartitions("part", *layout.by))

    return pack


def compressed(layout: Layout, rows: DataFrame) -> DataFrame:
    """A pack for many short rows: those that a task has for a partition travel as sorted and compressed blocks, each a small parquet file in a row."""
    order = [(c, "ascending") for c in layout.sort or layout.key]
    columns = [f.strip().split()[0] for f in layout.schema.split(", ")]

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        all_rows = pa.Table.from_batches(held).sort_by([("part", "ascending"), *order]).combine_chunks()
        parts = all_rows["part"].to_numpy()
        starts = np.flatnonzero(np.diff(parts, prepend=parts[0] - 1))
        made, bare = [], all_rows.drop_columns(["part"])
        for start, end in zip(starts, [*starts[1:], len(parts)], strict=True):
            sink = pa.BufferOutputStream()
            pq.write_table(bare.slice(start, end - start), sink, compression="zstd", write_statistics=False)
            made.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(parts[starts], pa.int32()), pa.array(made, pa.binary())], ["part", "block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield blocks(held)
                held, n = [], 0
        if n:
            yield blocks(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
                for own in pq.read_table(pa.BufferReader(block.as_buffer())).to_batches():
                    yield own.append_column("part", pa.array(np.full(own.num_rows, part, np.int32)))

    packed = rows.select(*columns).withColumn("part", layout.part()).mapInArrow(pack, "part int, block binary")
    return packed.hint("rebalance", "part").mapInArrow(unpack, f"{layout.schema}, part int").sortWithinPartitions("part", *(c for c, _ in order))


class Table:
    """A table of increments under a path. Every change gives a new version; the object reads the newest one."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout):
        self.spark, self.path, self.layout = spark, path, layout
        self.columns = [f.strip().split()[0] for f in layout.schema.split(", ")]

    def version(self) -> tuple[int, list, list[str]]:
        """Number, base folders with their partitions, and logs, the oldest first; number 0 for a table that isn't there."""
        try:
            last = self.spark.read.schema(f"{COMMIT}, version int").json(f"{self.path}/commits").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0, [], []
            raise
        return (last["version"], [(b["folder"], b["parts"]) for b in last["base"]], list(last["logs"])) if last else (0, [], [])

    def _commit(self, number: int, base: list, logs: list[str]) -> None:
        rows = self.spark.createDataFrame([([{"folder": f, "parts": p} for f, p in base], logs)], COMMIT)
        rows.coalesce(1).write.mode("errorifexists").json(f"{self.path}/commits/version={number}")

    @staticmethod
    def _name(kind: str, number: int) -> str:
        """A folder of its own for each attempt, so that what a broken one left behind is in nobody's way."""
        return f"{kind}-{number + 1}-{uuid.uuid4().hex[:12]}"

    def _write(self, rows: DataFrame, folder: str, pack: Pack | None = None) -> list[int]:
        """Write rows by partition, a large partition by several tasks; the partitions that were written. With `pack`, rows travel as it packs them."""
        order = self.layout.sort or self.layout.key
        if pack is None:
            laid = rows.withColumn("part", self.layout.part()).hint("rebalance", "part").sortWithinPartitions("part", *order)
        else:
            laid = pack(self.layout, rows)
        return self._put(laid, folder)

    def _put(self, laid: DataFrame, folder: str) -> list[int]:
        laid.write.mode("errorifexists").option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/{folder}")
        return [r[0] for r in self._folder(folder, "op string").select("part").distinct().collect()]

    def _folder(self, folder: str, more: str = "") -> DataFrame:
        schema = f"{self.layout.schema}, part int" + (f", {more}" if more else "")
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):  # nothing was written
                return self.spark.createDataFrame([], schema)
            raise

    def create(self, rows: DataFrame, pack: Pack | None = None) -> None:
        """The first version, of rows that have each key once, or that `pack` makes into such."""
        number, _, _ = self.version()
        folder = self._name("base", number)
        self._commit(number + 1, [(folder, self._write(rows if pack else rows.select(self.columns), folder, pack))], [])

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Put rows in place of those with the same key. Of rows that share a key the one with the greatest `order` counts, else the greatest one."""
        rest = [c for c in self.columns if c not in self.layout.key]
        place = [F.col(order)] if order else []

        def once(layout: Layout, given: DataFrame) -> DataFrame:
            """Rows with one key are in one task by their partition and a part of it, so they are dealt out once, by these, and settled there."""
            dealt = given.withColumn("part", layout.part()).withColumn("_deal", F.pmod(F.xxhash64(*layout.key), F.lit(DEALS))).repartition("part", "_deal")
            own = ["part", "_deal", *layout.key]
            if rest:
                last = dealt.groupBy(*own).agg(F.max(F.struct(*(x.alias(f"_{k}") for k, x in enumerate(place)), *rest)).alias("_last"))
                last = last.select("part", *layout.key, *(F.col(f"_last.{c}").alias(c) for c in rest))
            else:
                last = dealt.select(*own).distinct().drop("_deal")
            return last.select(*self.columns, F.lit("put").alias("op"), "part").sortWithinPartitions("part", *(layout.sort or layout.key))

        self._log(rows, "put", once)

    def delete(self, groups: DataFrame) -> None:
        """Delete the rows of groups."""
        absent = [F.lit(None).cast(kind).alias(c) for c, kind in self.spark.createDataFrame([], self.layout.schema).dtypes if c not in self.layout.group]
        self._log(groups.select(*self.layout.group).distinct().select("*", *absent), "delete")

    def _log(self, rows: DataFrame, op: str, pack: Pack | None = None) -> None:
        number, base, logs = self.version()
        if len(logs) >= LOGS:
            self.compact()
            number, base, logs = self.version()
        folder = self._name("log", number)
        self._write(rows if pack else rows.select(*self.columns, F.lit(op).alias("op")), folder, pack)
        self._commit(number + 1, base, [*logs, folder])

    def read(self, keys: dict[str, list] | None = None) -> DataFrame:
        """The newest rows; with `keys`, values of the column by which the table is laid out, only those, out of the partitions and row groups that can hold them."""
        _, base, logs = self.version()
        return self._merged(base, logs, lambda rows: self._only(rows, keys) if keys else rows).drop("part")

    def read_for(self, wanted: DataFrame) -> DataFrame:
        """The newest rows whose laid-out columns stand in `wanted`, a table that may be large; a small one prunes partitions when it is known."""
        _, base, logs = self.version()
        named = wanted.select(*self.layout.by).distinct().withColumn("part", self.layout.part())
        return self._merged(base, logs, lambda rows: _same(rows, named, ["part", *self.layout.by], "left_semi")).drop("part")

    def _only(self, rows: DataFrame, keys: dict[str, list]) -> DataFrame:
        (name, values), = keys.items()
        if [name] != self.layout.by:
            raise ValueError(f"laid out by {self.layout.by}")
        return rows.where(F.col("part").isin(*(self.layout.part(F.lit(v)) for v in values)) & F.col(name).isin(*values))

    def _merged(self, base: list, logs: list[str], only) -> DataFrame:
        """Base and logs as one: of what is said of a key, the last counts."""
        held = [self._folder(folder).where(F.col("part").isin(parts)) for folder, parts in base if parts]
        none = self.spark.createDataFrame([], f"{self.layout.schema}, part int")
        rows = only(reduce(DataFrame.unionByName, held, none) if len(held) != 1 else held[0])
        if not logs:
            return rows
        said = only(reduce(DataFrame.unionByName, (self._folder(name, "op string").withColumn("_at", F.lit(k)) for k, name in enumerate(logs))))
        gone = said.where("op = 'delete'").groupBy(*self.layout.group).agg(F.max("_at").alias("_gone"))
        put = said.where("op = 'put'").groupBy(*self.layout.key).agg(F.max_by(F.struct(*rows.columns), "_at").alias("_row"), F.max("_at").alias("_put"))
        fresh = _same(put, gone, self.layout.group, "left").where("_gone is null or _put > _gone").select("_row.*")
        kept = _same(_same(rows, put.select(*self.layout.key), self.layout.key, "left_anti"), gone.select(*self.layout.group), self.layout.group, "left_anti")
        return kept.unionByName(fresh)

    def compact(self) -> None:
        """Write the partitions that have logs anew, and drop the logs; other partitions stay where they are."""
        number, base, logs = self.version()
        if not logs:
            return
        touched = sorted({r[0] for name in logs for r in self._folder(name, "op string").select("part").distinct().collect()})
        rows = self._merged(base, logs, lambda rows: rows.where(F.col("part").isin(touched))).drop("part")
        folder = self._name("base", number)
        parts = self._write(rows, folder)
        rest = [(name, [p for p in own if p not in touched]) for name, own in base]
        self._commit(number + 1, [(name, own) for name, own in rest if own] + [(folder, parts)], [])
