"""Whitening of embeddings by shifted CholeskyQR.

Vectors become whole numbers, are centred and stay where they are; only Gram matrices, as large as
the dimension squared, leave the tasks. A pass adds up the Gram matrix of the centred rows, its
shifted Cholesky factor orthogonalises them through a triangular solve, and the next pass
does the same to the rows so obtained, until they are orthonormal. The product of the factors is R; its
singular value decomposition gives the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers are floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: A larger entry's whole number has no place in 64 bits; its vector is left out.
LARGEST = float(1 << 52)
#: Numbers that a task works on at once.
BLOCK = 1 << 20
#: Passes at most; each brings directions a million times closer to orthonormal.
PASSES = 4
#: Below this, rows are orthonormal enough for the factor at hand to finish the work.
NEARLY = 1e-6
#: Directions whose singular value is smaller, relative to the greatest, have no variance but rounding.
NO_VARIANCE = 1e-12


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows (vec_id, vector) whose entries are present, finite and below :data:`LARGEST`."""
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("vector")).where("vector is not null and size(vector) > 0")
    return rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers (a row per vector), some rows at a time."""
    if not batch.num_rows:
        return
    size = len(batch.column("vector")[0])
    step = max(1, BLOCK // size)
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        entries = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        yield part.column("vec_id"), np.floor(entries * SCALE).astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Centre:
    """Number of vectors and, exactly, their mean: whole part and remainder over n in each dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exactly; None where 64 bits don't hold it."""
        off = x - self.whole
        if (float(self.n) * (float(np.abs(off).max(initial=0)) + 1)) ** 2 * x.shape[1] < 2.0**62:
            return ((self.n * off - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.rest.tolist())) for row in off.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def centre(rows: DataFrame) -> Centre | None:
    """Exact sums of all whole numbers; None for no rows."""

    def run(batches):
        high = low = None
        n = 0
        for batch in batches:
            for _, x in _blocks(batch):
                # Two halves, so that no sum overflows.
                a, b = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                high, low, n = (a, b, len(x)) if high is None else (high + a, low + b, n + len(x))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(high), dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(len(high), n, np.int64))],
                ["dim", "high", "low", "n"],
            )

    sums = rows.mapInArrow(run, "dim int, high bigint, low bigint, n bigint").groupBy("dim").agg(
        *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")), F.sum("n").alias("n")
    )
    found = sorted(sums.collect())  # one row per dimension
    if not found:
        return None
    n = found[0].n
    means = [divmod((int(r.high) << 32) + int(r.low), n) for r in found]
    return Centre(n, *(np.array(v, dtype=np.int64) for v in zip(*means)))


def solve_lower(upper: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows @ inv(upper) by substitution; ``rows`` and the result hold a column per vector."""
    out = rows.copy()
    for j in range(len(upper)):
        out[j] -= upper[:j, j] @ out[:j]
        out[j] /= upper[j, j]
    return out


def _matrix(rows: DataFrame, size: int, block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of the symmetric size x size matrices that ``block`` makes of them."""
    above = np.triu_indices(size)

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in _blocks(batch):
                total += block(x)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(above[0].astype(np.int32)), pa.array(above[1].astype(np.int32)), pa.array(total[above])], ["i", "j", "value"]
            )

    sums = rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((size, size))
    for i, j, value in sums.collect():  # as many as the dimension squared
        out[i, j] = out[j, i] = value
    return out


def gram(rows: DataFrame, middle: Centre, chosen: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """The Gram matrix of the centred rows after a triangular solve with each of ``factors``."""

    def block(x):
        z = np.ascontiguousarray(middle.centred(x)[:, chosen].T)
        for factor in factors:
            z = solve_lower(factor, z)
        return z @ z.T

    return _matrix(rows, len(chosen), block)


def shifted_factor(matrix: np.ndarray, far: bool) -> np.ndarray:
    """The upper Cholesky factor, of the matrix and a small multiple of the identity if it is ``far`` from it."""
    size = len(matrix)
    shift = 100 * size * np.finfo(float).eps * np.trace(matrix) if far else 0.0
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, np.finfo(float).eps * np.trace(matrix))


def triangular(rows: DataFrame, middle: Centre, chosen: np.ndarray, first: np.ndarray) -> np.ndarray:
    """R of the centred rows, composed of the factors of repeated passes; ``first`` is their Gram matrix."""
    factors: list[np.ndarray] = []
    matrix, off = first, np.inf
    for _ in range(PASSES):
        factors.append(shifted_factor(matrix, off > 0.5))
        if off < NEARLY:
            break
        matrix = gram(rows, middle, chosen, factors)
        off = np.abs(matrix - np.eye(len(chosen))).max()
    composed = factors[0]
    for factor in factors[1:]:
        composed = factor @ composed
    return composed


@dataclass(frozen=True)
class Whitening:
    """``weights`` (dimension x components) take centred rows to whitened values."""

    middle: Centre
    weights: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.middle.centred(x) @ self.weights


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """Components by falling variance, those without variance left out; None if there are none."""
    middle = centre(rows)
    if middle is None:
        return None
    whole = gram(rows, middle, np.arange(len(middle.whole)), [])
    chosen = np.flatnonzero(np.diag(whole) > 0)  # dimensions that vary
    if not len(chosen):
        return None
    _, values, vectors = np.linalg.svd(triangular(rows, middle, chosen, whole[np.ix_(chosen, chosen)]))
    top = min(components, int((values > NO_VARIANCE * values[0]).sum()))
    directions = vectors[:top].T
    directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(top)])
    variances = values**2 / middle.n
    weights = np.zeros((len(whole), top))
    weights[chosen] = directions / np.sqrt(variances[:top])
    return Whitening(middle, weights, variances[:top], variances[:top] / variances.sum())


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened values' covariance less the identity.

    A block hands on its covariance about its own mean and that mean; the spread of the means is added in the end.
    """
    size = model.weights.shape[1]

    def run(batches):
        for batch in batches:
            n, mean, spread = 0, np.zeros(size), np.zeros((size, size))
            for _, x in _blocks(batch):
                values = model.whitened(x)
                own = values.mean(axis=0)
                step, both = own - mean, n + len(x)
                spread += (values - own).T @ (values - own) + np.outer(step, step) * (n * len(x) / both)
                mean, n = mean + step * (len(x) / both), both
            if n:
                yield pa.RecordBatch.from_pylist([{"n": n, "mean": mean.tolist(), "spread": spread.ravel().tolist()}])

    kept = rows.mapInArrow(run, "n bigint, mean array<double>, spread array<double>")
    # Means first; they are close to zero, so what their spread adds is summed without loss.
    at = F.posexplode("mean").alias("i", "m")
    means = np.zeros(size)
    for i, m in kept.select("n", at).groupBy("i").agg(F.sum(F.col("n") * F.col("m"))).collect():
        means[i] = m / model.middle.n
    off = F.transform("mean", lambda m, i: m - F.get(F.lit(means.tolist()), i))
    entry = F.col("s") + F.col("n") * F.get("off", F.floor(F.col("k") / size).cast("int")) * F.get("off", F.col("k") % size)
    total = np.zeros(size * size)
    exploded = kept.withColumn("off", off).select("n", "off", F.posexplode("spread").alias("k", "s"))
    for k, s in exploded.groupBy("k").agg(F.sum(entry)).collect():
        total[k] = s / model.middle.n
    return float(np.abs(total.reshape(size, size) - np.eye(size)).max())


def whiten(vectors: DataFrame, components: int = 8, column: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error.

    Takes part: vectors without missing, non-finite or too large entries (:data:`LARGEST`), of the length
    that most of them have (ties: the greater). Rows that repeat and missing ids count like any other.
    Components without variance are left out, so equal vectors, one vector and no vectors give no rows.
    Further columns are ignored. deviation is NULL beyond 64 bits.
    """
    schema = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = usable(vectors, column)
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.where(F.size("vector") == (lengths.length if lengths else 0))
    model = fit(rows, components)
    error = identity_error(rows, model) if model else 0.0
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for ids, x in _blocks(batch) if model else ():
                values = model.whitened(x)
                n, top = values.shape
                owner = pa.array(np.repeat(np.arange(n), top))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(owner), pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), n)), pa.array(np.full(n * top, model.middle.n)),
                        pa.array(model.middle.deviations(x), pa.int64()).take(owner), pa.array(values.ravel()),
                        pa.array(np.tile(model.explained, n)), pa.array(np.full(n * top, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"vec_id {kind}, {schema}")
