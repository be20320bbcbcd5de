"""Substring dedup by relative Lempel-Ziv parsing of every document against the documents before it.

The reference of a document is every document with a smaller id. It is indexed in blocks: a window of WINDOW words belongs to the block that its
minimizer names, the least hash of its GRAM-word parts, so neighbouring windows mostly meet in one block and travel as one run. The windows of a hot
minimizer are dealt over several blocks by their own hash; equal windows have equal hashes, so they still meet. Each block finds the
first owner of each of its windows and answers every other document with factors: stretches that one earlier document holds without a break. The parse
then goes over a document from left to right, takes the factor that reaches furthest, and at each factor's boundary looks at the factors that begin
inside it, so that no window across a boundary is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, hash_words, mix, shuffle_partitions, text_bytes, window_hashes, words_of

WINDOW, GRAM = 13, 7
BLOCK_BYTES = 12 << 20  #: of text whose windows one block indexes
LONGEST = 255  #: windows of one run, whose length travels as a byte
HOT_WINDOWS = 1 << 17  #: of one minimizer, in documents' windows as counted on the sample, for which it gets another block
SAMPLE = 32  #: one of so many documents is counted to find hot minimizers; it only decides where windows meet, never whether
CHUNK = 4096  #: documents that are looked at together before the shuffle; their numbers fit 16 bits


def _windows(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents' word hashes end to end: document number, position, minimizer and the 64-bit hash of all words of each window."""
    empty = np.empty(0, np.int64)
    if len(words) < WINDOW:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    whole = window_hashes(words, WINDOW)
    grams = window_hashes(words, GRAM)
    core = grams[: len(whole)].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(core, grams[k : k + len(whole)], out=core)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(whole)]
    at = np.arange(len(whole))
    inside = at + WINDOW <= ends[doc]
    return doc[inside], (at - (ends - counts)[doc])[inside], core[inside], whole[inside]


def _owners(whole: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the least document id that has it, and the first position there."""
    order = np.lexsort((at, ids, whole))
    own = whole[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    owner = np.empty(len(own), np.int64)
    owner[order] = np.repeat(order[first], np.diff(np.r_[first, len(own)]))
    return ids[owner], at[owner]


def _runs(*same: np.ndarray, step: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where runs begin: rows whose `same` equal those before and whose `step` are one more."""
    if not len(step[0]):
        return np.empty(0, np.int64)
    on = np.ones(len(step[0]) - 1, bool)
    for x in same:
        on &= x[1:] == x[:-1]
    for x in step:
        on &= x[1:] == x[:-1] + 1
    return np.flatnonzero(np.r_[True, ~on])


def _factors(doc: np.ndarray, at: np.ndarray, owner: np.ndarray, owner_at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows in order of (doc, at) to factors: doc, first word, words, owner, first word there."""
    begin = _runs(doc, owner, step=(at, owner_at))
    length = np.diff(np.r_[begin, len(at)]) + WINDOW - 1 if len(at) else np.empty(0, np.int64)
    return doc[begin], at[begin], length, owner[begin], owner_at[begin]


SENT = "block int, ids binary, versions binary, doc binary, at binary, size binary, whole binary, owner binary, owner_at binary"


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as bytes: all lowest ones, then all next ones, so that those that hardly differ stand together and the shuffle's compression shrinks them."""
    return np.ascontiguousarray(values.astype(kind)).view("u1").reshape(len(values), -1).T.tobytes() if len(values) else b""


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(size, -1).T).view(kind).ravel()


def hot_cores(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The minimizers of over HOT_WINDOWS windows, sorted, and among how many blocks each is dealt. There are no more of them than windows / HOT_WINDOWS."""
    least = max(2, HOT_WINDOWS // SAMPLE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hash_words(words_of(t)) for t in batch.column("text").to_pylist()]
            _, _, core, _ = _windows(np.concatenate([np.empty(0, np.uint64), *found]), np.array([len(x) for x in found], np.int64))
            cores, n = np.unique(core, return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(cores[often].view(np.int64)), pa.array(n[often])], ["core", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(SAMPLE)) == 0).select("text")
    rows = sample.mapInArrow(count, "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy("core").collect()
    cores = np.array([r["core"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(cores)
    return cores[order], np.array([1 + r["n"] // least for r in rows], np.uint64)[order]


def _parts(core: np.ndarray, whole: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each window the part of its minimizer, 0 if that isn't hot."""
    part = np.zeros(len(core), np.uint64)
    if len(hot[0]):
        place = np.minimum(np.searchsorted(hot[0], core), len(hot[0]) - 1)
        own = np.flatnonzero(hot[0][place] == core)
        part[own] = whole[own] % hot[1][place[own]]
    return part


def _index(blocks: int, hot: tuple[np.ndarray, np.ndarray]):
    """Runs of windows to their blocks. Of the chunk's own repeats only the first owner's windows travel; the factors of the others pass along whole."""

    def chunk(ids: np.ndarray, versions: np.ndarray, texts: list[str | None]) -> Iterator[dict]:
        found = [hash_words(words_of(t)) for t in texts]
        doc, at, core, whole = _windows(np.concatenate(found), np.array([len(x) for x in found]))
        owner, owner_at = _owners(whole, ids[doc], at)
        later = owner < ids[doc]
        d, a, n, o, oa = _factors(doc[later], at[later], owner[later], owner_at[later])
        # These are answers already; they pass through any block, so they are dealt evenly.
        for part, rows in _split((mix(ids[d].view(np.uint64)) % np.uint64(blocks)).astype(np.int64)):
            yield _row(part, ids, versions, d[rows], a[rows], _planes(n[rows], "<u4"), owner=_planes(o[rows], "<i8"), owner_at=_planes(oa[rows], "<u4"))
        doc, at, core, whole = doc[~later], at[~later], core[~later], whole[~later]
        dealt = _parts(core, whole, hot)
        begin = _runs(doc, core, dealt, step=(at,))
        size = np.diff(np.r_[begin, len(at)]) if len(at) else begin
        if len(size) and size.max() > LONGEST:
            begin = np.concatenate([np.arange(b, b + n, LONGEST) for b, n in zip(begin, size, strict=True)])
            size = np.diff(np.r_[begin, len(at)])
        for part, rows in _split((mix(core[begin] + dealt[begin] * STEP) % np.uint64(blocks)).astype(np.int64)):
            picked = np.repeat(begin[rows] - np.r_[0, np.cumsum(size[rows])[:-1]], size[rows]) + np.arange(size[rows].sum())
            yield _row(part, ids, versions, doc[begin[rows]], at[begin[rows]], _planes(size[rows], "u1"), whole=whole[picked].astype("<u8").tobytes())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int32()), *((c.split()[0], pa.binary()) for c in SENT.split(", ")[1:])])
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                yield pa.RecordBatch.from_pylist(list(chunk(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version")), part.column("text").to_pylist())), schema)

    return index


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    begin = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    for s, e in zip(begin, [*begin[1:], len(part)], strict=True):
        yield int(part[order[s]]), order[s:e]


def _row(block: int, ids: np.ndarray, versions: np.ndarray, doc: np.ndarray, at: np.ndarray, size: bytes, **more: bytes) -> dict:
    """Runs in order of their documents, so one bit tells whether a run is the first of the next document."""
    begins = np.r_[True, doc[1:] != doc[:-1]]
    used = doc[begins]
    return {"block": block, "ids": _planes(ids[used], "<i8"), "versions": versions[used].astype("<i8").tobytes(), "doc": np.packbits(begins).tobytes(), "at": _planes(at, "<u4"), "size": size, **more}


FOUND = "doc_id long, version long, at int, size int, owner long, owner_at int"


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """The factors of one block, a row for each, so that their number doesn't depend on that of the blocks."""
    out: list[list[np.ndarray]] = []
    index: list[list[np.ndarray]] = []
    for r in rows.itertuples():
        at = _numbers(r.at, "<u4").astype(np.int64)
        number = np.cumsum(np.unpackbits(np.frombuffer(r.doc, "u1"), count=len(at))) - 1
        ids, versions = _numbers(r.ids, "<i8")[number], np.frombuffer(r.versions, "<i8")[number]
        if r.whole is None:
            out.append([ids, versions, at, _numbers(r.size, "<u4").astype(np.int64), _numbers(r.owner, "<i8"), _numbers(r.owner_at, "<u4").astype(np.int64)])
        else:
            size = _numbers(r.size, "u1").astype(np.int64)
            along = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            index.append([np.repeat(ids, size), np.repeat(versions, size), np.repeat(at, size) + along, np.frombuffer(r.whole, "<u8")])
    if index:
        ids, versions, at, whole = (np.concatenate(x) for x in zip(*index, strict=True))
        owner, owner_at = _owners(whole, ids, at)
        later = np.flatnonzero(owner < ids)
        later = later[np.lexsort((at[later], versions[later], ids[later]))]
        both = np.stack([ids[later], versions[later]], axis=1)
        number = np.cumsum(np.r_[0, (both[1:] != both[:-1]).any(axis=1)]) if len(later) else later
        d, a, n, o, oa = _factors(number, at[later], owner[later], owner_at[later])
        begin = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(later) else later
        out.append([both[begin][d, 0], both[begin][d, 1], a, n, o, oa])
    if not out:
        return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
    return pd.DataFrame(dict(zip((c.split()[0] for c in FOUND.split(", ")), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))


def parse(n: int, factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Greedy parse of n words into factors (first word, words, owner, first word there) with their overlaps cut off at the left; words outside them are literals.

    At each point the factor is taken that starts there or inside the factor before, and reaches furthest.
    """
    out, here, k = [], 0, 0
    factors = sorted(factors)
    best: tuple[int, int, int, int] | None = None
    while here < n:
        while k < len(factors) and factors[k][0] <= here:
            best = factors[k] if best is None or sum(factors[k][:2]) > sum(best[:2]) else best
            k += 1
        if best is not None and best[0] + best[1] > here:
            skip = here - best[0]
            out.append((here, best[1] - skip, best[2], best[3] + skip))
            here = best[0] + best[1]
        elif k < len(factors):
            here = factors[k][0]
        else:
            break
    return out


def factorise(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text) and the factors of WINDOW words or more that earlier documents hold, as the parallel arrays at, size, owner, owner_at; documents without any are left out."""
    blocks = max(shuffle_partitions(docs.sparkSession), -(-text_bytes(docs) // BLOCK_BYTES))
    read = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")
    found = read.mapInArrow(_index(blocks, hot_cores(read)), SENT).groupBy("block").applyInPandas(_answer, FOUND)
    factors = F.collect_list(F.struct("at", "size", "owner", "owner_at"))
    return found.groupBy("doc_id", "version").agg(factors.alias("factors")).select("doc_id", "version", *(F.col(f"factors.{c}").alias(c) for c in ("at", "size", "owner", "owner_at")))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors and the removed spans (first word, end) of every row of docs.

    A word goes if a window of 13 words covers it that also starts in a document with a smaller doc_id; windows are judged on the input. Rows with
    the same doc_id don't remove each other's words. A null text has no words; a row with a null doc_id loses none and removes none. Rows that occur twice
    come out twice; extra columns are ignored; an empty table gives an empty result. Windows are told apart by the 64-bit hash of all
    their words and by their block, which the hash of their minimizer names: at 1.6e13 windows in 8e6 blocks, one false match is to be expected.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = factorise(docs).withColumnsRenamed({"doc_id": "f_id", "version": "f_version"})
    joined = docs.join(found, (F.col("doc_id") == F.col("f_id")) & (F.xxhash64("text") == F.col("f_version")), "left").select("doc_id", "text", "at", "size", "owner", "owner_at")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, *factors in zip(*(batch.column(c).to_pylist() for c in ("text", "at", "size", "owner", "owner_at")), strict=True):
                words = words_of(text)
                spans = parse(len(words), list(zip(*factors, strict=True))) if factors[0] else []
                left = bytearray(b"\1") * len(words)
                for start, size, *_ in spans:
                    left[start : start + size] = bytes(size)
                rows.append((len(words), len(words) - sum(left), hashlib.sha256(b" ".join(compress(words, left))).hexdigest(), len(spans), [{"start": s, "end": s + n} for s, n, *_ in spans]))
            n, gone, digest, count, spans = zip(*rows, strict=True) if rows else [()] * 5
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(count, pa.int32()), pa.array(spans, kind)], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "spans"])

    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors int, spans array<struct<start:int,end:int>>")
