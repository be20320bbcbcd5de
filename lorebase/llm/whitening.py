"""PCA whitening of embeddings: eigenpairs of the covariance by spectrum slicing.

Inertia counts of L D L^T factors of the shifted covariance say how many eigenvalues lie above a shift. Bisection on these counts isolates each leading
eigenvalue, Rayleigh quotient iteration refines it, and two more counts certify its number. Only the covariance, whose size depends on the length of a
vector alone, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000  #: of the fixed-point numbers that vectors are turned into
PIVOT = (1 + 17**0.5) / 8  #: share of the largest entry that a diagonal entry must have to be a pivot of its own
FAR = 2.0**62  #: fixed-point numbers end here
LONG = 2**63 - 1


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than shift: the positive ones of D in L D L^T = matrix - shift I, with complete pivoting.

    A pivot is one diagonal entry, or two rows whose block has an eigenvalue of each sign.
    """
    rest, above = matrix - shift * np.eye(len(matrix)), 0
    while len(rest):
        sizes = np.abs(rest)
        own = sizes.diagonal().copy()
        np.fill_diagonal(sizes, 0)
        one = int(own.argmax())
        two = divmod(int(sizes.argmax()), len(rest))
        if own[one] >= PIVOT * sizes[two]:
            if own[one] == 0:
                break
            pivots, above = [one], above + int(rest[one, one] > 0)
        else:
            pivots, above = list(two), above + 1
        block, side = rest[np.ix_(pivots, pivots)], np.delete(rest[:, pivots], pivots, axis=0)
        rest = np.delete(np.delete(rest, pivots, axis=0), pivots, axis=1) - side @ np.linalg.solve(block, side.T)
        rest = (rest + rest.T) / 2
    return above


def _refine(matrix: np.ndarray, at: float, found: np.ndarray, size: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the shift `at`, orthogonal to the eigenvectors that are known."""
    rng = np.random.default_rng(len(found))
    x, shift, best = rng.standard_normal(len(matrix)), at, (np.inf, at, np.zeros(len(matrix)))
    for step in range(60):
        x -= found.T @ (found @ x)
        norm = np.linalg.norm(x)
        if not 0 < norm < np.inf:
            break
        x /= norm
        value = float(x @ matrix @ x)
        left = float(np.linalg.norm(matrix @ x - value * x))
        if left < best[0]:
            best = (left, value, x.copy())
        elif step > 6 and best[0] < 1e-10 * size:
            break
        if step >= 3:  # the first steps keep the shift, so that x turns to the eigenvalue next to it
            shift = value
        try:
            x = np.linalg.solve(matrix - shift * np.eye(len(matrix)), x)
        except np.linalg.LinAlgError:
            x = np.linalg.solve(matrix - (shift + np.spacing(size)) * np.eye(len(matrix)), x)
    return best[1], best[2]


def leading_eigenpairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as rows; at most `most`, and none that is zero to double precision.

    Equal eigenvalues, or those nearer to each other than 1e-13 of the trace, are one cluster, whose vectors are any orthogonal ones of its space.
    The largest entry of a vector is positive. Raises ArithmeticError if the counts don't confirm a number.
    """
    size = float(np.trace(matrix))
    values, vectors = np.empty(0), np.empty((0, len(matrix)))
    if not size > 0:
        return values, vectors
    floor, top = len(matrix) * np.finfo(float).eps * size, size * (1 + 1e-9)
    counts = {floor: count_above(matrix, floor), top: 0}
    for k in range(1, min(most, counts[floor]) + 1):
        low, high = max(s for s in counts if counts[s] >= k), min(s for s in counts if counts[s] < k)
        while True:
            close = high - low <= 1e-13 * size
            if close or counts[low] == k and counts[high] == k - 1:
                value, vector = _refine(matrix, (low + high) / 2, vectors, size)
                if close or low <= value <= high:
                    break
            middle = (low + high) / 2
            counts[middle] = count_above(matrix, middle)
            low, high = (middle, high) if counts[middle] >= k else (low, middle)
        slack = 1e-12 * size
        if count_above(matrix, value + slack) >= k or count_above(matrix, value - slack) < k:
            raise ArithmeticError(f"counts don't confirm eigenvalue {k}")
        values, vectors = np.append(values, value), np.vstack([vectors, vector * np.sign(vector[np.abs(vector).argmax()])])
    return values, vectors


def _fixed(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """The fixed-point numbers of a batch of vectors of one length."""
    entries = np.asarray(batch.column("vector").flatten(), np.float64).reshape(-1, length)
    return np.clip(np.floor(SCALE * entries) + OFFSET, -FAR, FAR).astype(np.int64)


def _exactly(x: np.ndarray, most: float) -> np.ndarray:
    """x as it is if no result can exceed `most`, as numbers of any size otherwise."""
    return x if most < 2.0**62 else x.astype(object)


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


def _summed(vectors: DataFrame, length: int, size: int, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Sums over all vectors of the entries of the array of `size` entries that `of` makes of each batch: place and total."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_fixed(batch, length)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["place", "part"])

    return vectors.select("vector").mapInArrow(add, "place int, part double").groupBy("place").agg(F.sum("part").alias("total"))


def _sums(vectors: DataFrame, length: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * length
        for x in (_fixed(batch, length) for batch in batches):
            n += len(x)
            total = [a + int(b) for a, b in zip(total, _exactly(x, _largest(x) * len(x)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()), pa.array([str(x) for x in total])], ["dim", "n", "part"])

    found = vectors.select("vector").mapInArrow(add, "dim int, n long, part string").groupBy("dim").agg(F.sum("n"), F.sum(F.col("part").cast("decimal(38,0)"))).collect()
    found.sort()
    return (found[0][1], [int(x[2]) for x in found]) if found else (0, [])


def _matrix(found: list, length: int) -> np.ndarray:
    out = np.zeros(length * length)
    for place, total in found:
        out[place] = total
    return out.reshape(length, length)


def whitened(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """Whiten all vectors by the leading eigenpairs of their covariance. For each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(1024 c) + 100000 (kept within 2^62). n counts the vectors; deviation is the sum over dimensions of (n x - S)^2, exact, null where it doesn't
    fit into a long; whitened is the centred x projected on the component over the root of its eigenvalue; explained is the eigenvalue over the trace;
    identity_error is the largest absolute entry of the covariance of `whitened` minus the identity.

    Left out: rows whose vector is null, empty, or holds null or non-finite entries, and vectors of another length than most have (the greater length of those that are
    equally frequent). Rows that repeat, and null ids, are rows of their own. Components whose eigenvalue is zero to double precision can't be whitened and don't occur, so
    equal vectors, one vector, or an empty table give no rows. Extra columns are ignored. The vectors are read once for each of lengths, sums, covariance,
    check and result; covariance and check are sums of small arrays of each task, of the square of a vector's length, and that is what the driver sees.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    vectors = vectors.where("size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    usual = vectors.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if not usual:
        return spark.createDataFrame([], schema)
    length = usual["length"]
    vectors = vectors.where(F.size("vector") == length)
    n, sums = _sums(vectors, length)
    mean = np.array([s / n for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _matrix(_summed(vectors, length, length**2, products).collect(), length) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = leading_eigenpairs(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    turn = (axes / np.sqrt(values)[:, None]).T
    explained, k = values / np.trace(covariance), len(values)

    def checked(x: np.ndarray) -> np.ndarray:
        out = np.hstack([(x - mean) @ turn, np.ones((len(x), 1))])
        return out.T @ out

    check = _matrix(_summed(vectors, length, (k + 1) ** 2, checked).collect(), k + 1) / n
    error = float(np.abs(check[:k, :k] - np.outer(check[k, :k], check[k, :k]) - np.eye(k)).max())
    long_sums = np.array(sums, object)
    largest = max(abs(s) for s in sums)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _fixed(batch, length)
            if not len(x):
                continue
            apart = _exactly(x, max(largest, _largest(x) * n) * 2)
            apart = n * apart - (long_sums if apart.dtype == object else long_sums.astype(np.int64))
            squares = (_exactly(apart, _largest(apart) ** 2 * length) ** 2).sum(axis=1)
            deviation = [int(s) if s <= LONG else None for s in squares]
            made = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(((x - mean) @ turn).reshape(-1)),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(made, schema=pa.schema(list(zip(names, (m.type for m in made), strict=True))))

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return vectors.mapInArrow(turned, schema)
