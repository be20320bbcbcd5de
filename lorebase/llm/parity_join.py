"""N-gram Jaccard join by parity sketches.

Each shingle flips one bit of a document's sketch, so two sketches differ in at most as many bits as the sets differ in members. A sketch is cut into more parts
than the sets of a link can differ in, so links share a whole part: documents of one size band meet by equal parts, and every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, cut, lists, lower_words_of, mix, shingles, signed
from .components import components
from .near_dedup import BITS, _bridges, _possible, _rest, parity_bitmap

WIDTH = 1 << 16  #: bits of a part of a sketch
THIN = 1  #: a part with so many bits set says little
SALTS = 8  #: parts of a hub's pairs


def most_apart(size: int, percent: int) -> int:
    """The most members in which a set of `size` members and a set as large or larger differ, if 100 * intersection >= percent * union."""
    return size * (100 - percent) // percent


def band_edges(upto: int) -> list[int]:
    """The least size of each size band, up to and beyond `upto`; a band reaches to 7/5 of its least size."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(max(edges[-1] + 1, edges[-1] * 7 // 5))
    return edges


def bands_of(size: int, percent: int) -> list[tuple[int, int]]:
    """The bands in which a set meets others, each with the least size beyond it: its own, and smaller ones that hold sets to which it may be linked.
    A link is found in the band of its smaller set."""
    edges = band_edges(size)
    return [(k, edges[k + 1]) for k in range(len(edges) - 1) if edges[k + 1] > size or 100 * (edges[k + 1] - 1) >= percent * size]


def part_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """A key for each part of a set's sketches in the bands it belongs to. Linked sets that aren't equal share one at least.

    In a band whose sets differ from linked ones in at most d members, the sketch has d + 1 + spare parts, so more than `spare` of them are equal in both. A sketch
    with at most `spare` thin parts keeps its other parts only; one with more keeps all. Of more than `spare` equal parts, one at least is then kept by both.
    """
    out = [np.empty(0, np.uint64)]
    spread = mix(grams ^ np.uint64(0x6A09E667F3BCC909))
    for band, beyond in bands_of(len(grams), percent):
        apart = most_apart(beyond - 1, percent)
        if not apart:  # only equal sets are linked
            continue
        spare = 1 + apart // 32
        parts = apart + 1 + spare
        places, times = np.unique(spread % np.uint64(parts * WIDTH), return_counts=True)
        odd = places[times % 2 == 1]
        part = (odd // np.uint64(WIDTH)).astype(np.int64)
        bits = np.bincount(part, minlength=parts)
        content = np.zeros(parts, np.uint64)
        if len(odd):
            content[bits > 0] = np.bitwise_xor.reduceat(mix(odd), np.flatnonzero(np.r_[True, part[1:] != part[:-1]]))
        keys = mix(content ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)))
        thin = bits <= THIN
        out.append(keys if thin.sum() > spare else keys[~thin])
    return np.concatenate(out)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def digests(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, and set_a and set_b, a 128-bit digest of the set; these are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(lower_words_of(text), words) for text in batch.column("text").to_pylist()]
            made = [_digest(x) if len(x) else (None, None) for x in sets]
            arrays = [pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_shingles", "set_a", "set_b"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long")


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, the digest, part keys and a parity bitmap of each document whose set isn't empty."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(lower_words_of(text), words) for text in batch.column("text").to_pylist()]
            full = [k for k, x in enumerate(sets) if len(x)]
            sets = [sets[k] for k in full]
            made, keys = [_digest(x) for x in sets], [part_keys(x, percent) for x in sets]
            arrays = [
                batch.column("doc_id").take(pa.array(full, pa.int32())),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([x[0] for x in made], pa.int64()),
                pa.array([x[1] for x in made], pa.int64()),
                lists(signed(np.concatenate([np.empty(0, np.uint64), *keys])), np.array([len(x) for x in keys], np.int64), pa.int64()),
                lists(np.array([parity_bitmap(x) for x in sets], np.int64).reshape(-1), np.full(len(sets), BITS // 64), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_a", "set_b", "keys", "bitmap"])

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, bitmap array<long>")


def beside_counted(rows: DataFrame, facts: DataFrame, by: list[str], total: int) -> DataFrame:
    """rows with the facts of their key; facts has a row a key, with n, the rows of that key. Of all `total` rows, at most FEW keys can have more than a
    FEW-th; these facts are broadcast, so no task meets more than a FEW-th of the rows for one key."""
    hot = facts.where(F.col("n") * FEW > total).drop("n").withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), by, "left")
    out = [*rows.columns, *(c for c in facts.columns if c not in (*by, "n"))]
    return marked.where("_hot").select(out).union(marked.where("_hot is null").select(rows.columns).join(facts.where(F.col("n") * FEW <= total).drop("n"), by).select(out))


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough. The pairs of one `a` are dealt over SALTS parts, and its set is made once for each."""
    dealt = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    right = dealt.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb")), "b")
    left = dealt.select("a", "_salt").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b, found = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for k in range(batch.num_rows):
                text = batch.column("_ta")[k].as_py()
                if text != last:
                    last, mine = text, shingles(lower_words_of(text), words)
                other = shingles(lower_words_of(batch.column("_tb")[k].as_py()), words)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    found.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in found], pa.int64()), pa.array([b[k] for k in found], pa.int64())], ["a", "b"])

    return right.join(left, ["a", "_salt"]).select("a", "b", "_ta", "_tb").mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """Groups of documents joined by links; doc_id, n_shingles, component_id for every row.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of distinct shingles of `words` words, A-Z lower-cased; component_id is the least doc_id
    that links reach. No link between different texts is lost (shingles are told apart by 64 bits): equal sets form a class, of which the least doc_id stands for
    all, and linked sets that differ share a part of their sketches. Of those that share a part, each is compared with the least doc_id it meets first; then
    members of different components are compared in tiles of bounded size. So a group of copies costs about as many comparisons as it has members.

    A null, empty or blank text has no shingles and is linked with nothing; fewer words than `words` are one shingle. Rows with a null doc_id get a null component_id and are linked with
    nothing. Rows that repeat a doc_id are one document, linked by any of its texts. Extra columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = cut(digests(docs, words))
    linkable = known.where("doc_id is not null and n_shingles > 0")
    classes = linkable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    of_class = beside_counted(linkable.select("doc_id", "set_a", "set_b"), classes, ["set_a", "set_b"], linkable.count()).select("doc_id", "class_id").distinct()

    sketched = sketches(docs.where("doc_id is not null"), words, percent)
    heads = sketched.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "bitmap", "keys")).alias("head"))
    heads = cut(heads.select("head.*"))
    keys = heads.select("doc_id", F.explode("keys").alias("key"))
    total = heads.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = cut(beside_counted(keys, buckets, ["key"], total))

    ids = members.select("doc_id").distinct()
    marks = cut(heads.join(ids, "doc_id", "left_semi").select("doc_id", "n_shingles", "bitmap").dropDuplicates(["doc_id", "bitmap"]))
    texts = cut(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    stars = members.groupBy("doc_id").agg(F.min("hub").alias("a")).where("a < doc_id").select("a", F.col("doc_id").alias("b"))
    links = cut(_linked(_possible(stars, marks, percent).distinct(), texts, words, percent))
    joined = members.select(F.lit(0).alias("band"), "key", "doc_id").join(components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left")
    joined = joined.withColumn("component", F.coalesce("component", "doc_id"))
    more = _linked(_rest(joined, marks, percent), texts, words, percent)

    found = components(links.union(more).union(_bridges(of_class)))
    by_class = of_class.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    ended = by_class.groupBy("doc_id").agg(F.min(F.coalesce("component", "class_id")).alias("component_id"))
    named = known.where("doc_id is not null").select("doc_id", "n_shingles").join(ended, "doc_id", "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return named.union(known.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long")))

