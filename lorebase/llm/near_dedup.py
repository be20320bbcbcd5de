"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard verification, connected components.

Two fixed bijections of the 32-bit numbers stand for the two permutations: the first scatters the shingles, and coordinate k of a signature is
the least value of the second over all shingles, each shifted circularly by k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lists, lower_words_of, mix, shingles, signed
from .components import components

BITS = 2048  #: of the parity bitmap of a shingle set
BLOCK = 8192  #: shingles that are permuted at once
SALTS = 8  #: parts of a bucket or of a hub's pairs, so that no task meets all of a large one
GRAMS = 100  #: shingles that are as large as a document's other facts
TILE = 256  #: documents on each side of a tile of a bucket


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_minhash(grams: np.ndarray, size: int) -> np.ndarray:
    """`size` coordinates of the signature of a non-empty set of 64-bit shingle hashes."""
    first = (mix(grams ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(first), BLOCK):
        np.minimum(least, _second(first[None, k : k + BLOCK] + shifts).min(axis=1), out=least)
    return least


def parity_bitmap(grams: np.ndarray) -> np.ndarray:
    """Each member of the set flips one of BITS bits. The bits in which two bitmaps differ are at most as many as the members in which the sets differ."""
    flips = np.bincount((grams >> np.uint64(53)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, words: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit digest of the set), band keys and the parity bitmap; the last four are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, keys, bitmaps = [], [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingles(lower_words_of(text), words)
                counts.append(len(grams))
                if len(grams):
                    digest = xxhash.xxh3_128_digest(grams.tobytes())
                    digests.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                    signature = circulant_minhash(grams, bands * rows).reshape(bands, rows)
                    keys.append([xxhash.xxh3_64_intdigest(x.tobytes()) for x in signature])
                    bitmaps.append(parity_bitmap(grams))
            full = np.array(counts, np.int64) > 0
            place = pa.array(np.cumsum(full) - 1, pa.int64(), mask=~full)
            made = [
                pa.array([x[0] for x in digests], pa.int64()),
                pa.array([x[1] for x in digests], pa.int64()),
                lists(signed(np.array(keys, np.uint64).reshape(-1)), np.full(len(keys), bands), pa.int64()),
                lists(np.array(bitmaps, np.int64).reshape(-1), np.full(len(bitmaps), BITS // 64), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *(x.take(place) for x in made)], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bitmap"])

    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bitmap array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the distinct shingle hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(lower_words_of(text), words) for text in batch.column("text").to_pylist()]
            grams = lists(signed(np.concatenate([np.empty(0, np.uint64), *found])), np.array([len(x) for x in found], np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), grams], ["doc_id", "grams"])

    return docs.mapInArrow(build, "doc_id long, grams array<long>")


def _possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that sizes and bitmaps leave possible. It loses no link: 100 i >= p u means a difference of at most (100 - p) / (100 + p) of both sizes' sum."""
    left = marks.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("bitmap").alias("ma"))
    right = marks.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bitmap").alias("mb"))
    apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (apart * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb")))
    # The first of a pair may be in very many of them.
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = left.join(pairs.select("a").distinct(), "a", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["a", "salt"]).join(right, "b").where(fits).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - common
    return both.where(100 * common >= percent * union).select("a", "b").distinct()


def _rest(members: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Possible pairs between different components of one bucket. The hub's component is the bucket's core, whose members needn't meet each other;
    all others meet each other and the core, in tiles of bounded size, and only pairs that sizes and bitmaps leave possible come out."""
    bucket = ["band", "key"]
    state = members.groupBy(*bucket).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("doc_id", "component"))["component"].alias("core")).where("low < high")
    rows = members.join(state.select(*bucket, "core"), bucket).withColumn("other", F.col("component") != F.col("core"))
    sizes = rows.groupBy(*bucket).agg(F.sum(F.col("other").cast("long")).alias("n_other"), F.count("*").alias("n"))
    sizes = sizes.select(*bucket, F.ceil(F.col("n_other") / TILE).alias("others"), F.ceil((F.col("n") - F.col("n_other")) / TILE).alias("cores"))
    dealt = rows.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("other"), F.col("others")).otherwise(F.col("cores"))))
    block = F.col("block")
    dealt = dealt.withColumn("meets", F.explode(F.sequence(F.lit(0), F.when(F.col("other"), F.col("others") + F.col("cores")).otherwise(F.col("others")) - 1)))
    meets = F.col("meets")
    inner = F.col("other") & (meets < F.col("others"))
    one = F.when(inner, F.least(block, meets)).when(F.col("other"), block).otherwise(meets)
    two = F.when(inner, F.greatest(block, meets)).when(F.col("other"), meets).otherwise(F.col("others") + block)
    left = F.col("other") & (~inner | (block <= meets))
    right = ~F.col("other") | (inner & (block >= meets))
    tiles = dealt.select("doc_id", "component", F.xxhash64("band", "key", one, two).alias("tile"), left.alias("left"), right.alias("right"))
    tiles = tiles.join(marks.select("doc_id", "n_shingles", "bitmap"), "doc_id").select("tile", "doc_id", "component", "n_shingles", "left", "right", "bitmap")

    def pairs(rows: pa.Table) -> np.ndarray:
        tile, ids, comps, sizes, left, right = (rows[c].to_numpy() for c in ("tile", "doc_id", "component", "n_shingles", "left", "right"))
        maps = rows["bitmap"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(tile), BITS // 64)
        sides = left.astype(bool), right.astype(bool)
        starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        found = [np.empty((0, 2), np.int64)]
        for s, e in zip(starts, np.r_[starts[1:], len(tile)], strict=True):
            rights = s + np.flatnonzero(sides[1][s:e])
            for i in s + np.flatnonzero(sides[0][s:e]):
                js = rights[(comps[rights] != comps[i]) & (100 * np.minimum(sizes[rights], sizes[i]) >= percent * np.maximum(sizes[rights], sizes[i]))]
                if len(js):
                    apart = np.bitwise_count(maps[js] ^ maps[i]).sum(axis=1, dtype=np.int64)
                    js = js[apart * (100 + percent) <= (100 - percent) * (sizes[js] + sizes[i])]
                    if len(js):
                        found.append(np.stack([np.minimum(ids[js], ids[i]), np.maximum(ids[js], ids[i])], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches in order of tiles; the last tile of a batch waits for the next one, so no more is held than a batch and a tile."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            tile = rows["tile"].to_numpy()
            last = int(np.searchsorted(tile, tile[-1]))
            held = rows.slice(last).combine_chunks()
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(rows.slice(0, last)).T], ["a", "b"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(held).T], ["a", "b"])

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """Group near-duplicate documents; returns doc_id, n_shingles, component_id, kept for every row.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets, confirmed on full sets; component_id is the
    least doc_id reachable. Equal sets form one class, and only its least doc_id is signed, compared and linked. With 32 bands of 4 rows, a link at
    0.75 is missed by every band with probability 5e-6. In a bucket, every member is compared with the least one first; then members of
    different components are compared with each other, so a large group costs about as many comparisons as it has members.

    A null, empty or blank text has no shingles and is linked with nothing. Rows with a null doc_id are returned with a null component_id and
    kept. Rows that repeat a doc_id are one document. Extra columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed_docs = cut(signatures(docs, words, bands, rows))
    n, n_grams = signed_docs.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    linkable = signed_docs.where("doc_id is not null and n_shingles > 0")
    classes = linkable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id"))
    of_class = linkable.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("doc_id", "class_id").distinct()
    heads = linkable.join(classes.select(F.col("class_id").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"]).dropDuplicates(["doc_id", "set_a"])
    heads = cut(heads.select("doc_id", "n_shingles", "bands", "bitmap"), n)

    keys = heads.select("doc_id", F.posexplode("bands").alias("band", "key"))
    # The members of a bucket are dealt over SALTS parts, each of which gets a copy of the bucket's row.
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    buckets = keys.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").drop("last")
    copies = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = cut(salted.join(copies, ["band", "key", "salt"]).select("band", "key", "doc_id", "hub"), n)
    ids = members.select("doc_id").distinct()
    marks = cut(heads.join(ids, "doc_id", "left_semi").select("doc_id", "n_shingles", "bitmap"), n)
    sets = cut(shingle_sets(docs.join(ids, "doc_id", "left_semi"), words), max(n, n_grams // GRAMS))

    stars = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = cut(_verified(_possible(stars, marks, percent), sets, percent), n)
    known = members.join(components(links, n).withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = known.withColumn("component", F.coalesce("component", "doc_id"))
    more = _verified(_rest(known, marks, percent), sets, percent)
    # A document that occurs with several texts is in several classes; then its class links join them.
    found = components(links.union(more).union(_bridges(of_class)), n)
    by_class = of_class.join(found.select(F.col("node").alias("class_id"), F.col("component")), "class_id", "left")
    ended = by_class.groupBy("doc_id").agg(F.min(F.coalesce("component", "class_id")).alias("component_id"))
    out = signed_docs.select("doc_id", "n_shingles").join(ended, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _bridges(of_class: DataFrame) -> DataFrame:
    """Links between the classes of a document that occurs with several texts."""
    ends = of_class.groupBy("doc_id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high")
    return of_class.join(ends, "doc_id").where("class_id <> low").select(F.col("class_id").alias("a"), F.col("low").alias("b"))
