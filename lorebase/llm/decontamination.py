"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A benchmark item of n words leaks into a document if a stretch of it is within n // SHARE word edits of the item. Items, and windows of documents as long as they, are
embedded by CGK random walks, under which a small edit distance becomes a small Hamming distance. Each of TABLES hash tables keys them by a sample of
places of one walk; items and windows that share a key are joined, and each pair is verified by its exact edit distance. Windows are embedded
only where enough parts of items stand close together for any leak (parts() says how many survive the edits), which loses none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_words, lower_words_of, mix, signed, window_hashes

SHARE = 5  #: words of an item for each edit that is allowed
RECALL = 0.999
SAMPLED = 3  #: places in each sample
AGREE = 0.4  #: share of places that agree, at the most edits that are allowed; tests measure the recall that follows
TABLES = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLED))
WALKS = 16  #: random walks among which the tables are divided
STRETCH = 1.8  #: places of an embedding for each word; a walk takes about two for a word, so few pass the end
PARTS = (3, 2, 1)  #: words of the parts by which windows are found that are worth an embedding
PART_BITS, KEY_BITS = 22, 24  #: of the hashes for which the bitmaps have a bit; a full bitmap only lets more through
SALTS = 16  #: parts of a key that very many windows have
WINDOWS = 512  #: that are embedded at once


def bucket_keys(texts: np.ndarray) -> np.ndarray:
    """texts (count, words) -> (count, TABLES) of 64-bit keys: of the length, the table, and the sampled places of the table's walk.

    A walk writes the word where it stands at each of STRETCH * words places, 0 behind the last word, and goes on to the next one by a coin of word, walk and place.
    """
    count, n = texts.shape
    padded = np.concatenate([texts, np.zeros((count, 1), np.uint64)], axis=1)
    draw = np.random.default_rng(n)
    asked: dict[int, list[tuple[int, int]]] = {}
    for table in range(TABLES):
        for k, place in enumerate(draw.integers(0, max(1, int(STRETCH * n)), SAMPLED).tolist()):
            asked.setdefault(place, []).append((table, k))
    at = np.zeros((WALKS, count), np.int64)
    row, seed = np.arange(count)[None, :], np.arange(WALKS, dtype=np.uint64)[:, None] * np.uint64(100003)
    sampled = np.empty((TABLES, SAMPLED, count), np.uint64)
    for place in range(max(asked) + 1):
        words = padded[row, at]
        for table, k in asked.get(place, ()):
            sampled[table, k] = words[table % WALKS]
        coins = mix(words + (seed + np.uint64(place)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
        at = np.minimum(at + coins.astype(np.int64), n)
    keys = np.repeat((np.uint64(n << 32) + np.arange(TABLES, dtype=np.uint64))[:, None], count, axis=1)
    for k in range(SAMPLED):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sampled[:, k])
    return keys.T


def parts(n: int) -> tuple[int, int]:
    """Words of a part, and how many parts of an item of n words are left whole, at least, in a stretch within its edits: the longest parts of which any is."""
    edits = n // SHARE
    return next((size, left) for size in PARTS if size <= n and (left := n - size + 1 - size * edits) > 0)


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The least word edit distance of the item from a stretch of text, with the start and end of the stretch."""

    def sweep(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        along = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        for k, word in enumerate(a):
            least = np.empty_like(row)
            least[0] = k + 1
            least[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != word))
            row = np.minimum.accumulate(least - along) + along
        return row

    row = sweep(item, text)
    end = int(row.argmin())
    back = sweep(item[::-1], text[:end][::-1])
    return int(row[end]), end - int(back.argmin()), end


def of_length(keys: np.ndarray, n: int) -> np.ndarray:
    """Part hashes bound to the length of the items that have them."""
    return mix(keys + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15))


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """rows (key) -> words of a bitmap in which the upper `bits` bits of each key are set. At most 2 ** (bits - 6) rows come to the driver."""
    place = F.shiftrightunsigned("key", 64 - bits)
    # A bit as a power of two: shiftleft() by a column, which it takes in SQL only.
    words = rows.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    place = keys >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) == 1


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with words: their number of words, word hashes, part hashes, bare and of the item's length, and bucket keys."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            rows = []
            for ref, item_id, text in zip(*(x.to_pylist() for x in batch.slice(k, 64).columns), strict=True):
                words = hash_words(lower_words_of(text))
                if n := len(words):
                    size, _ = parts(n)
                    found = window_hashes(words, size)
                    rows.append((ref, item_id, n, words.tobytes(), size, signed(found), signed(of_length(found, n)), signed(bucket_keys(words[None, :])[0])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["ref", "item_id", "n", "words", "size", "parts", "own_parts", "keys"])


ITEMS = "ref long, item_id long, n int, words binary, size int, parts array<long>, own_parts array<long>, keys array<long>"


DOCUMENT = 1 << 32  #: between the places of one document and the next


def _near(hits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places of parts, sorted: the stretches (first, last) of starts at which a window of n words can lie that holds enough of them."""
    size, left = parts(n)
    reach = n + n // SHARE - size
    close = np.flatnonzero(hits[left - 1 :] - hits[: max(0, len(hits) - left + 1)] <= reach)
    # These parts lie inside the stretch that is like the item, so it starts no earlier than `reach` before the last, and no later than the first.
    high = hits[close]
    low = np.maximum(hits[close + left - 1] - reach, high // DOCUMENT * DOCUMENT)
    if not len(close):
        return low, high
    begin = np.flatnonzero(np.r_[True, low[1:] > high[:-1] + 1])
    return np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)


def _regions(lengths: list[int], part_bits: dict[int, np.ndarray], own_bits: np.ndarray, key_bits: np.ndarray):
    """Of each document the regions where windows share keys with items: the region's place and words, and the keys. lengths: of items, in words."""

    def keyed(n: int, blocks: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int, bytes, np.ndarray]]:
        keys = bucket_keys(np.concatenate([np.lib.stride_tricks.sliding_window_view(text, n) for *_, text, _ in blocks]))
        at = 0
        for doc, block, until, _, own in blocks:
            found = np.unique(keys[at : at + until - block + 1])
            at += until - block + 1
            found = found[_marked(key_bits, found)]
            if len(found):
                low = max(0, block - n // SHARE)
                yield doc, n, low, own[low : until + n + n // SHARE].tobytes(), found

    def of_documents(words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, bytes, np.ndarray]]:
        begins = np.r_[0, ends[:-1]]
        hits = {}
        for size, bitmap in part_bits.items():
            grams = window_hashes(words, size)
            at = np.flatnonzero(_marked(bitmap, grams))
            doc = np.searchsorted(ends, at, "right")
            inside = at + size <= ends[doc]
            hits[size] = (at - begins[doc] + doc * DOCUMENT)[inside], grams[at][inside]
        for n in lengths:
            places, grams = hits[parts(n)[0]]
            waiting, count = [], 0
            for first, last in zip(*(x.tolist() for x in _near(places[_marked(own_bits, of_length(grams, n))], n)), strict=True):
                doc, first, last = first // DOCUMENT, first % DOCUMENT, last % DOCUMENT
                own = words[begins[doc] : ends[doc]]
                for block in range(first, last + 1, WINDOWS):
                    until = min(last, block + WINDOWS - 1)
                    text = np.zeros(until - block + n, np.uint64)
                    text[: max(0, len(own) - block)] = own[block : until + n]
                    waiting.append((doc, block, until, text, own))
                    count += until - block + 1
                    if count >= WINDOWS:
                        yield from keyed(n, waiting)
                        waiting, count = [], 0
            if waiting:
                yield from keyed(n, waiting)

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                found = [hash_words(lower_words_of(t)) for t in part.column("text").to_pylist()]
                rows = list(of_documents(np.concatenate(found), np.cumsum([len(x) for x in found])))
                doc, n, at, raw, keys = zip(*rows, strict=True) if rows else [()] * 5
                picked = part.take(pa.array(doc, pa.int64()))
                made = [pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(raw, pa.binary()), pa.array([signed(x) for x in keys], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([picked.column("row"), picked.column("doc_id"), *made], ["row", "doc_id", "n", "at", "text", "keys"])

    return regions


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of regions and items, of which those stay that are within the edits."""
    for batch in batches:
        kept, found = [], []
        for k, (n, at, text, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "at", "text", "words")), strict=True)):
            distance, start, end = best_stretch(np.frombuffer(words, np.uint64), np.frombuffer(text, np.uint64))
            if distance <= n // SHARE:
                kept.append(k)
                found.append((distance, at + start, at + end))
        columns = list(zip(*found, strict=True)) if found else [()] * 3
        rows = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), rows.column("ref"), rows.column("item_id"), *(pa.array(c, pa.int32()) for c in columns), rows.column("n")], ["row", "doc_id", "ref", "item_id", "distance", "start", "end", "n_words"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start, end, n_words: every pair of a document and a benchmark item that leaks into it, with its nearest stretch.

    Words [^\\x20\\x09-\\x0D]+, lower-cased A-Z, of whole texts; start and end count words. Items of under SHARE words must stand word for word. Null, empty and blank items are left
    out. A null text has no words; a null doc_id stays null; a row that occurs twice gives its pairs twice, an item that occurs twice likewise; extra columns are ignored;
    an empty table on either side gives an empty result. A leak is missed by all tables with probability 1 - RECALL at the most edits. What goes to all executors are bitmaps of fixed
    size and the lengths of items, of which there are at most as many as the longest item has words.
    """
    numbered = items.select(F.monotonically_increasing_id().alias("ref"), F.col("item_id").cast("long"), F.col("text").cast("string"))
    known = cut(numbered.mapInArrow(_items, ITEMS))
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())
    each_part = known.select("size", F.explode("parts").alias("key"))
    part_bits = {size: _bitmap(each_part.where(F.col("size") == size), PART_BITS) for size in {parts(n)[0] for n in lengths}}
    keyed = known.select("ref", F.explode("keys").alias("key"))
    own_parts = _bitmap(known.select(F.explode("own_parts").alias("key")), PART_BITS)
    search = _regions(lengths, part_bits, own_parts, _bitmap(keyed, KEY_BITS))
    # The numbers of rows and regions are made before they are cut, so they stay when executors are lost.
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = read.mapInArrow(search, "row long, doc_id long, n int, at int, text binary, keys array<long>")
    regions = cut(found.withColumn("region", F.monotonically_increasing_id()))
    salt, every = F.pmod("region", F.lit(SALTS)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    asked = regions.select("region", F.explode("keys").alias("key")).withColumn("salt", salt)
    pairs = asked.join(keyed.withColumn("salt", every), ["key", "salt"]).select("region", "ref").distinct()
    whole = pairs.join(regions.drop("keys"), "region").withColumn("salt", salt)
    both = whole.join(known.select("ref", "item_id", "words").withColumn("salt", every), ["ref", "salt"])
    pair = ["row", "doc_id", "ref", "item_id"]
    kept = both.select(*pair, "n", "at", "text", "words").mapInArrow(_verify, "row long, doc_id long, ref long, item_id long, distance int, start int, end int, n_words int")
    best = kept.groupBy(*pair, "n_words").agg(F.min(F.struct("distance", "start", "end")).alias("best"))
    return best.select("doc_id", "item_id", "best.*", "n_words")
