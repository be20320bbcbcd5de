"""Language identification by nearest centroids of TF-IDF vectors of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 4096  #: dimensions, into which n-grams of 1 to 3 letters are hashed
SAMPLE = 400  #: labelled documents of each language on which the centroids are fitted, those with the least hashes
CENTROIDS = 4  #: of each language
ROUNDS = 10  #: of clustering
REJECT = 1.5  #: times the distance within which 99 % of the sample lie from their nearest centroid; further away is rejected
UNKNOWN = "und"
SLICE = 256  #: documents that are counted at once


LETTERS: list[np.ndarray] = []  #: made once by each process


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not LETTERS:
        LETTERS.append(np.array([chr(k).isalpha() for k in range(0x110000)]))
    return LETTERS[0]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts, SIZE) of the hashed n-grams of letters, words set off by one boundary; and whether each text has a letter."""
    codes = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(x) for x in codes])
    code = np.concatenate(codes)
    letter = _letters()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    use = letter.copy()
    use[1:] |= letter[:-1]  # one boundary after each word
    code, row, letter = code[use], row[use], letter[use]
    out = np.zeros(len(texts) * SIZE, np.int64)
    gram = np.zeros(len(code), np.uint64)
    for n in range(3):
        gram = gram[: len(code) - n] * np.uint64(0x9E3779B97F4A7C15) + code[n:] + np.uint64(n + 1)
        if not len(gram):
            break
        inside = row[: len(gram)] == row[n:]
        place = ((gram * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)).astype(np.int64)
        out += np.bincount((row[: len(gram)] * SIZE + place)[inside], minlength=len(out))
    return out.reshape(len(texts), SIZE), np.bincount(row, letter, len(texts)) > 0


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  #: of each centroid
    reach: np.ndarray  #: of each centroid, the cosine distance beyond which a text is rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        made = np.log1p(counts.astype(np.float32)) * self.idf
        return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for k in range(0, len(texts), SLICE):
            counts, has = counted([t or "" for t in texts[k : k + SLICE]])
            if not self.langs:
                out += [(UNKNOWN, 0.0, True)] * len(has)
                continue
            near = self.vectors(counts) @ self.centroids.T
            best = near.argmax(axis=1)
            score = np.clip(near[np.arange(len(best)), best], 0, 1)
            out += [(self.langs[b], float(s), bool(1 - s > self.reach[b])) if h else (UNKNOWN, 0.0, True) for b, s, h in zip(best, score, has, strict=True)]
        return out


def _clustered(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the points that are furthest from each other."""
    centres = [vectors.mean(axis=0)]
    centres[0] = vectors[(vectors @ centres[0]).argmax()]
    while len(centres) < min(k, len(vectors)):
        centres.append(vectors[(vectors @ np.array(centres).T).max(axis=1).argmin()])
    now = np.array(centres)
    for _ in range(ROUNDS):
        to = (vectors @ now.T).argmax(axis=1)
        now = np.array([vectors[to == i].mean(axis=0) if (to == i).any() else now[i] for i in range(len(now))])
        now /= np.maximum(np.linalg.norm(now, axis=1, keepdims=True), 1e-9)
    return now


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled (doc_id, text, lang): at most `sample` documents of each language, chosen by hash, counted on the executors. Null languages and texts teach nothing."""
    read = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string"), "text", F.xxhash64("doc_id", "text").alias("draw"))
    sizes = read.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    size = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], r["n"])))[F.col("lang")] if sizes else F.lit(1)
    # First all but about twice the sample by the hash alone, so that no text of the rest is shuffled and no window holds a whole language.
    some = read.where(F.pmod("draw", F.lit(1 << 30)) * size <= F.lit(2 * sample * (1 << 30)))
    few = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                counts, has = counted(part.column("text").to_pylist())
                made = pa.array([x.astype(np.uint32).tobytes() if h else None for x, h in zip(counts, has, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), made], ["lang", "place", "counts"])

    rows = few.select("lang", "place", "text").mapInArrow(count, "lang string, place int, counts binary").where("counts is not null").collect()
    rows.sort(key=lambda r: (r["lang"], r["place"]))
    if not rows:
        return Model(np.ones(SIZE, np.float32), np.empty((0, SIZE), np.float32), [], np.empty(0))
    counts = np.array([np.frombuffer(r["counts"], np.uint32) for r in rows])
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    model = Model(idf, np.empty((0, SIZE), np.float32), [], np.empty(0))
    vectors, lang = model.vectors(counts), np.array([r["lang"] for r in rows])
    made, reach = [], []
    for name in sorted(set(lang)):
        own = vectors[lang == name]
        centres = _clustered(own, CENTROIDS)
        made.append(centres)
        reach += [REJECT * float(np.quantile(1 - (own @ centres.T).max(axis=1), 0.99)) + 0.05] * len(centres)
        model.langs += [name] * len(centres)
    model.centroids, model.reach = np.concatenate(made).astype(np.float32), np.array(reach)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine with the nearest centroid) and rejected of every row, from its whole text alone.

    lang_pred is `und`, with score 0, for a null text or one without a letter, and for all texts if the model learned no language. A text that is too far from every
    centroid keeps the nearest language but is marked rejected. doc_id may be null or repeated; extra columns are ignored; an empty table gives an empty result.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column("text").to_pylist())
            lang, score, rejected = zip(*found, strict=True) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
