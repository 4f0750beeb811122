"""Operator 13: whitening of embeddings by eigenvectors in mixed precision.

The covariance is gathered in Spark: a first pass sums each dimension, a second multiplies the centred vectors of each task
with one another, block by block. Entries are integers, x = floor(1024 c) + 100000, and are centred by the nearest integer to their
mean before multiplying; products of a block stay below 2^53, so its matrix is exact, and sums travel as two 64-bit integers. What is
left of the mean is taken off exactly afterwards, so the covariance doesn't depend on how the rows lie over tasks or on tasks that
run twice. (If entries reach 2^25, all are scaled by a power of two, and products are rounded to double precision.)

The matrix, of the size of one vector squared whatever the corpus, is solved on the driver: eigenvectors in float32, then iterations
of Ogita and Aishima, which are matrix multiplications, in float64. Eigenvalues that lie closer than the iteration can tell apart are
clusters; the space of each is solved on its own, as a small matrix shifted by the cluster's mean, and iterated on.

Vectors are then projected in Spark; the error of the identity is that of the projected rows' own covariance, another pass.

Defined cases: a vector that is null, or has null or non-finite entries, or one that no long integer can hold after scaling, is
dropped; the most frequent length (the longer one on ties) is the space, and vectors of other lengths are dropped, as are empty ones;
null ids and repeated rows are rows like others; without any vector left the result is empty. A component without variance (its
eigenvalue is at most 1e-12 of the largest) is whitened to 0 and isn't counted in the identity's error. deviation is null
where no long integer can hold it. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatescan.llm.sums import collected

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Most rows of a block, the part of a sum that travels in an integer of its own, and its bits behind the point.
BLOCK, LOW, POINT = 4096, 1 << 26, 10
#: Eigenvalues nearer than this part of the largest are a cluster: products in float64 can't tell their vectors apart well enough.
NEAR = 1e-7
#: A component whose eigenvalue is at most this part of the largest has no variance.
NO_VARIANCE = 1e-12


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the rows whose entries are all finite and small enough for long integers."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= F.lit(float(1 << 51)))
    return vectors.select(F.col(id_col).alias("id"), v.alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", bad))


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their x-vectors (rows by dimensions, int64)."""
    for b in batches:
        if b.num_rows:
            flat = b.column(at).flatten().to_numpy(zero_copy_only=False)
            yield b, np.floor(flat * SCALE).astype(np.int64).reshape(b.num_rows, -1) + SHIFT


@dataclass
class Fit:
    """What the rows are projected with: n and the sums S of x, components (rows), eigenvalues, the covariance's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The integers nearest to the means, and what the means have beyond them."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(whole, dtype=np.int64), np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, whole, strict=True)])

    def variance(self) -> np.ndarray:
        return self.values > NO_VARIANCE * self.values[0]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) along each component, over the square root of its eigenvalue."""
        whole, rest = self.centre()
        along = ((x - whole).astype(np.float64) - rest) @ self.components.T
        return np.where(self.variance(), along / np.sqrt(np.where(self.variance(), self.values, 1.0)), 0.0)


def _gathered(rows: DataFrame, parts_of) -> DataFrame:
    """(part, total) of each task; parts_of(blocks of x) gives int64 vectors by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = parts_of(x for _, x in _blocks(batches, 0))
        if parts:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int32()), "total": pa.array([np.asarray(v, dtype="<i8").tobytes() for v in parts.values()], pa.binary())})

    return rows.select("vector").mapInArrow(run, "part int, total binary")


def _two(exact: np.ndarray) -> np.ndarray:
    """Numbers in float64 as two int64 vectors behind one another: multiples of LOW, and the rest in units of 2^-POINT."""
    high = np.floor(exact / LOW)
    return np.concatenate([high.ravel(), np.rint((exact - high * LOW) * (1 << POINT)).ravel()]).astype(np.int64)


def covariance(rows: DataFrame, dim: int, largest: float = 0.0) -> tuple[int, list[int], np.ndarray]:
    """(n, S, V) of rows whose entries c are at most `largest`: V is exact but for its last rounding, if they are below 2^15."""
    shift = max(0, math.ceil(math.log2(2 * largest * SCALE + 2)) - 26)

    def sums(blocks) -> dict:
        n, high, low = 0, np.zeros(dim, dtype=np.int64), np.zeros(dim, dtype=np.int64)
        for x in blocks:
            n += len(x)
            high += (x >> 26).sum(axis=0)
            low += (x & (LOW - 1)).sum(axis=0)
        return {0: np.concatenate([[n], high, low])} if n else {}

    got = collected(_gathered(rows, sums))[0]
    n, s = int(got[0]), [int(a) * LOW + int(b) for a, b in zip(got[1 : dim + 1], got[dim + 1 :], strict=True)]
    whole, _ = Fit(n, s, np.empty(0), np.empty(0), 0.0).centre()

    def products(blocks) -> dict:
        total = None
        for x in blocks:
            y = np.ldexp((x - whole).astype(np.float64), -shift)
            most = float(np.abs(y).max(initial=0.0))
            step = int(min(BLOCK, max(1, (1 << 53) // max(1.0, most * most))))
            for at in range(0, len(y), step):
                part = y[at : at + step]
                two = _two(part.T @ part).reshape(2, dim, dim)
                total = two if total is None else total + two
        return {} if total is None else {i: total[:, i].ravel() for i in range(dim)}

    got = collected(_gathered(rows, products))
    extra = [a - n * int(c) for a, c in zip(s, whole, strict=True)]  # sums of the centred integers
    v = np.empty((dim, dim))
    for i in range(dim):
        for j in range(dim):
            exact = (int(got[i][j]) * (LOW << POINT) + int(got[i][dim + j])) << 2 * shift
            v[i, j] = (n * exact - (extra[i] * extra[j] << POINT)) / (n * n << POINT)  # whole numbers, divided with one rounding
    return n, s, v


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One iteration: (x corrected, eigenvalues, pairs too near to tell apart, size of the correction). a has norm about 1."""
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(value)
    limit = max(NEAR, 2 * (np.linalg.norm(off) + np.linalg.norm(a) * np.linalg.norm(r)))  # Frobenius norms bound the others
    gap = value[None, :] - value[:, None]
    near = np.abs(gap) <= limit
    e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1.0, gap))
    return x + x @ e, value, near & ~np.eye(len(a), dtype=bool), float(np.abs(e).max())


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made so, by a step of Newton and Schulz."""
    return x @ (1.5 * np.eye(len(x)) - 0.5 * (x.T @ x))


def _clusters(value: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
    """Groups of eigenvalues that are linked by pairs too near to tell apart."""
    order = np.argsort(value)
    groups, now = [], [order[0]]
    for a, b in zip(order, order[1:], strict=False):
        if near[a, b]:
            now.append(b)
        else:
            groups.append(np.array(now))
            now = [b]
    return [g for g in [*groups, np.array(now)] if len(g) > 1]


def eigen(v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as rows) of a symmetric matrix: float32 vectors, corrected in float64."""
    scale = float(np.abs(v).max()) or 1.0
    a = v / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    eps = np.finfo(np.float64).eps
    for _ in range(rounds):
        x, value, near, size = _step(a, x)
        if near.any():
            x = _orthonormal(x)
            value = np.einsum("ij,ij->j", x, a @ x)
            for g in _clusters(value, near):
                own, mean = x[:, g], value[g].mean()
                small = own.T @ (a @ own - mean * own)
                x[:, g] = own @ np.linalg.eigh((small + small.T) / 2)[1]
        if size <= 4 * eps * len(a):
            break
    x = _orthonormal(_orthonormal(x))
    value = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-value, kind="stable")
    return np.maximum(value[order] * scale, 0.0), x[:, order].T


def fit(rows: DataFrame, dim: int, largest: float, components: int = COMPONENTS) -> Fit:
    """The fit of rows (vector) that are all of length dim, with entries of at most `largest`."""
    n, s, v = covariance(rows, dim, largest)
    values, vectors = eigen(v)
    return Fit(n, s, vectors[:components], values[:components], float(np.trace(v)))


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, over components that have variance."""
    k, unit = len(model.values), 1 << 40  # sums of whole multiples of 2^-40, so that their order doesn't matter

    def moments(blocks) -> dict:
        total = np.zeros(k + k * k)
        exact = np.zeros(2 * (k + k * k), dtype=np.int64)
        for x in blocks:
            w = model.whiten(x)
            total = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
            high = np.floor(total)
            exact += np.concatenate([high, np.rint((total - high) * unit)]).astype(np.int64)
        return {0: exact}

    got = collected(_gathered(rows, moments)).get(0)
    both = [(int(a) * unit + int(b)) / unit for a, b in zip(got[: k + k * k], got[k + k * k :], strict=True)]
    mean, second = np.array(both[:k]) / model.n, np.array(both[k:]).reshape(k, k) / model.n
    there = model.variance()
    off = np.abs(second - np.outer(mean, mean) - np.eye(k))[np.ix_(there, there)]
    return float(off.max(initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id_col, component int (from 1), n long, deviation long, whitened, explained, identity_error double: a row for each usable
    vector and component."""
    rows = usable(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("largest"))
    most, largest = sizes.agg(F.max_by("dim", F.struct("n", "dim")), F.max_by("largest", F.struct("n", "dim"))).first()
    if most is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = rows.where(F.size("vector") == most)
    model = fit(rows, most, largest, components)
    error, k = identity_error(rows, model), len(model.values)
    explained = model.values / model.trace if model.trace else np.zeros(k)
    sums = np.array(model.sums, dtype=object)
    whole, _ = model.centre()
    rest = np.array([int(s) - model.n * int(c) for s, c in zip(model.sums, whole, strict=True)], dtype=np.int64)  # n x - S = n (x - whole) - rest

    def deviations(x: np.ndarray) -> list[int | None]:
        y = x - whole
        if model.n * float(np.abs(y).max() + 1) < math.sqrt((1 << 62) / most):
            off = model.n * y - rest
            return (off * off).sum(axis=1).tolist()
        exact = ((x.astype(object) * model.n - sums) ** 2).sum(axis=1).tolist()
        return [d if d < 1 << 63 else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, 1):
            for at in range(0, len(x), BLOCK):
                own = x[at : at + BLOCK]
                m = len(own)
                each = pa.array(np.repeat(np.arange(at, at + m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, dtype=np.int64)), pa.array(deviations(own), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(model.whiten(own).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
