"""Quality rules: robust multivariate outliers by the minimum covariance determinant, per language and source.

Every document's statistics are transformed to a vector. In each group the subset of SUPPORT of the documents whose covariance has the least determinant
is approached by concentration steps over all documents: distances from the present centre, the group's quantile of them, then centre and covariance of
the documents within it. A document is rejected if its Mahalanobis distance from the last estimate is beyond its group's fence: Tukey's, on the logarithms of
the distances, first of the nearer half and then of the documents within the fence before, so that junk beyond a gap doesn't move it. No label takes part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, beside, cut, hash_words, quantiles, window_hashes, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
MIN_WORDS, REPEAT_PERCENT = 50, 50
SUPPORT = 0.5  #: share of a group that the estimate rests on; at half, up to nearly half of a group may be junk
STEPS = 5  #: concentration steps
GRID = 1024  #: logarithms of distances are told apart to 1 / GRID, so that their quantiles are exact counts
LEAST = 200  #: documents of a group of its own; smaller ones are pooled by language, then all together
#: Standard deviations below which a dimension isn't told apart: log words, word length, symbols, repeated lines, repeated words, capitals.
FLOOR = (0.4, 0.25, 0.06, 0.1, 0.1, 0.06)
SIZE = len(FLOOR)
#: Squared distances are scaled so that their median is that of chi squared with SIZE degrees of freedom. Fences stand at its 99.9 % point at least, and distances
#: below its 1 % point aren't told apart.
CUTOFF, NEAREST = 22.458, 0.872
TUKEY = 1.5  #: interquartile ranges above the upper quartile; of chi squared this is about its 99.98 % point
FENCES = 6  #: fences one after another
MEDIAN = SIZE * (1 - 2 / (9 * SIZE)) ** 3
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def statistics_of(text: str | None) -> tuple[int, ...]:
    """STATS of one text."""
    if not text:
        return (0,) * len(STATS)
    words = words_of(text)
    grams = window_hashes(hash_words(words), 3)
    repeated = 0
    if len(grams):
        _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
        often = count[place] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(grams)] |= often
        repeated = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    raw = text.encode("utf-8", "surrogatepass")
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(raw) - len(raw.translate(None, UPPER))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and STATS of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics_of(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(x) for x in found.T)], ["doc_id", "lang", "source", *STATS])

    read = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return read.mapInArrow(measure, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS))


def _vector() -> list[Column]:
    """The transformed statistics, rounded so that sums don't depend on their order."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    made = [F.log(words), F.col("word_chars") / words, F.sqrt(F.col("n_symbols") / words), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words), F.sqrt(F.col("n_upper") / F.greatest("word_chars", F.lit(1)))]
    return [F.round(x * 1024) / 1024 for x in made]


def _grouped(stats: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """Name the group of each document: language and source, or a pool where they have too few of the n documents. Also whether the groups are few enough to be broadcast."""
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in ("lang", "source"))
    named = stats.withColumn("own", F.concat_ws("\x1f", lang, source)).withColumn("wide", F.concat(F.lit("*\x1f"), lang))
    good = F.count_if(~F.col("base_failed"))
    sizes = cut(named.groupBy("own", "wide").agg(good.alias("n")), n)
    pools = sizes.where(F.col("n") < LEAST).groupBy("wide").agg(F.sum("n").alias("n_wide"))
    to = sizes.join(pools, "wide", "left").select("own", F.when(F.col("n") >= LEAST, F.col("own")).when(F.col("n_wide") >= LEAST, F.col("wide")).otherwise("*").alias("group"))
    few = sizes.count() <= FEW
    return beside(named, to, "own", few).drop("own", "wide"), few


def _logged(distance: Column, least: float) -> Column:
    """The logarithm of a distance on the grid; what is nearer than `least` counts as that far."""
    return F.round(F.log(F.greatest(distance, F.lit(least))) * GRID) / GRID


def _distance() -> Column:
    """Squared Mahalanobis distance of x from mean, by the flattened inverse."""
    apart = [F.col(f"x{i}") - F.col("mean")[i] for i in range(SIZE)]
    terms = [(2 if i < j else 1) * F.col("inverse")[i * SIZE + j] * apart[i] * apart[j] for i in range(SIZE) for j in range(i, SIZE)]
    return reduce(add, terms)


def _inverted(sums: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums and products of each group to its mean, inverse covariance and log determinant."""
    for rows in sums:
        n = rows["n"].to_numpy(float)[:, None]
        mean = rows[[f"s{i}" for i in range(SIZE)]].to_numpy(float) / n
        cov = np.zeros((len(rows), SIZE, SIZE))
        for i in range(SIZE):
            for j in range(i, SIZE):
                cov[:, i, j] = cov[:, j, i] = rows[f"p{i}_{j}"].to_numpy(float) / n[:, 0] - mean[:, i] * mean[:, j]
        cov += np.diag(np.square(FLOOR))
        yield pd.DataFrame({"group": rows["group"], "mean": list(mean), "inverse": list(np.linalg.inv(cov).reshape(len(rows), SIZE * SIZE)), "log_det": np.linalg.slogdet(cov)[1]})


def _start(vectors: DataFrame) -> DataFrame:
    """Centre and inverse covariance from the median and the quartile range of each dimension."""
    each = F.explode(F.array(*(F.struct("group", F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in range(SIZE))))
    values = vectors.select(each.alias("v")).select(F.struct("v.group", "v.i").alias("part"), F.col("v.x").alias("x"))
    quartiles = quantiles(values, "part", F.col("x"), {"low": 0.25, "middle": 0.5, "high": 0.75})
    pick = lambda i, x: F.max(F.when(F.col("part.i") == i, x))
    spread = [F.lit(FLOOR[i] ** 2) + F.pow(pick(i, F.col("high") - F.col("low")) / 1.349, 2) for i in range(SIZE)]
    flat = [1 / spread[i] if i == j else F.lit(0.0) for i in range(SIZE) for j in range(SIZE)]
    return quartiles.groupBy(F.col("part.group").alias("group")).agg(F.array(*(pick(i, F.col("middle")) for i in range(SIZE))).alias("mean"), F.array(*flat).alias("inverse"), F.lit(0.0).alias("log_det"))


def robust_estimates(vectors: DataFrame, few: bool, steps: int = STEPS) -> DataFrame:
    """vectors (group, x0 ...) -> group, mean, inverse, log_det of each group's minimum covariance determinant. few: there are at most FEW groups.

    Starts at the medians and quartile ranges of each dimension, so it needs no random subsets. Each step can only lessen the determinant.
    """
    most = FEW if few else None
    now = cut(_start(vectors), most)
    products = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
    for _ in range(steps):
        apart = beside(vectors, now, "group", few).withColumn("apart", _logged(_distance(), 1e-9)).drop("mean", "inverse", "log_det")
        near = quantiles(apart, "group", F.col("apart"), {"bound": SUPPORT})
        core = beside(apart, near, "group", few).where("apart <= bound")
        sums = core.groupBy("group").agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(SIZE)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in products))
        sums = sums.coalesce(1) if few else sums
        now = cut(sums.mapInPandas(_inverted, "group string, mean array<double>, inverse array<double>, log_det double"))
    return now


def fences(distances: DataFrame, few: bool, n: int) -> DataFrame:
    """n distances (group, distance) -> group, fence."""
    most = FEW if few else None
    counted = cut(distances.groupBy("group", _logged(F.col("distance"), NEAREST).alias("apart")).agg(F.count("*").alias("n")), n)
    own = Window.partitionBy("group")

    def quartiles(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
        ranked = rows.select("group", "apart", F.sum("n").over(own.orderBy("apart")).alias("upto"), F.sum("n").over(own).alias("all"))
        return ranked.groupBy("group").agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.lit(s) * F.col("all")), F.col("apart"))).alias(name) for name, s in shares.items()))

    now = cut(quartiles(counted, {"fence": SUPPORT}), most)
    for _ in range(FENCES):
        inside = beside(counted, now, "group", few).where("apart <= fence")
        reach = F.col("high") + TUKEY * (F.col("high") - F.col("low"))
        now = cut(quartiles(inside, {"low": 0.25, "high": 0.75}).select("group", F.greatest(reach, F.lit(float(np.log(CUTOFF)))).alias("fence")), most)
    return now.select("group", F.exp("fence").alias("fence"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, group and distance of every row.

    base_failed: fewer than 50 words, or over 50 % of them in 3-word windows that occur twice or more. Documents that fail take no part in the
    estimates. kept is false for them and for outliers. A null text has no words; null languages and sources are groups of their own; a row with a
    null doc_id is judged like any other; rows that occur twice count and come out twice; extra columns are ignored; an empty table gives an empty result. Pools with
    fewer documents than twice the dimensions reject nothing.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = cut(measured(docs).withColumn("base_failed", failed).withColumns({f"x{i}": x for i, x in enumerate(_vector())}))
    n = stats.count()
    grouped, few = _grouped(stats, n)
    named = cut(grouped, n)
    good = named.where("not base_failed")
    fitted = robust_estimates(good.select("group", *(f"x{i}" for i in range(SIZE))), few)
    apart = beside(good, fitted, "group", few).select("group", _logged(_distance(), 1e-9).alias("apart"))
    scale = quantiles(apart, "group", F.col("apart"), {"middle": 0.5}).join(apart.groupBy("group").agg(F.count("*").alias("fitted_on")), "group")
    facts = cut(fitted.join(scale, "group").withColumn("middle", F.exp("middle")), FEW if few else None)
    far = beside(named, facts, "group", few, "left").withColumn("distance", _distance() * MEDIAN / F.greatest("middle", F.lit(MEDIAN / 4)))
    far = cut(far.drop("mean", "inverse", "log_det", "middle", *(f"x{i}" for i in range(SIZE))), n)
    fenced = beside(far, fences(far.where("not base_failed and distance is not null").select("group", "distance"), few, n), "group", few, "left")
    outlier = F.coalesce((F.col("fitted_on") >= 2 * SIZE) & (F.col("distance") > F.col("fence")), F.lit(False))
    return fenced.select("doc_id", *STATS[:5], "base_failed", (~F.col("base_failed") & ~outlier).alias("kept"), "group", "distance", *STATS[5:])
