"""Embedding whitening: spectral divide-and-conquer over QDWH polar decompositions, applied by a small model sent to every task.

Vectors become whole numbers x = floor(1024 * c) + 100000. Tasks add up counts and sums, then products of centred rows; Spark sums what the
tasks found, and only dim * dim numbers reach the driver. There the covariance A is split: the polar factor U of A - m I (m: the mean
eigenvalue) has eigenvalues 1 and -1, (U + I) / 2 projects on the invariant subspace above m, and each of the two subspaces is split
again until every one has a single direction. QDWH finds U with inverse-free QR steps and weights that follow from a lower bound of the smallest
singular value, six steps at most in double precision.

Nothing is sampled: the fit list is all vectors that count, and so is what is whitened.

Edge cases: vectors that are null, empty, or hold a null, NaN or infinite entry are dropped, and so are those of another length than most
have (of lengths equally frequent the largest counts). Entries beyond 2**40 after scaling are set to that bound. Components whose
eigenvalue is zero to double precision have no direction and are left out, so a table of equal vectors gives no row; equal
eigenvalues have any orthonormal basis of their subspace. `deviation` is null where it does not fit in 64 bits. Repeated rows, null ids and
other columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffles_removed

SCALE, SHIFT = 1024, 100_000
_BOUND = float(1 << 40)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x as longs) of the vectors that count, one pair for each length."""
    if not len(column):
        return
    column = column.cast(pa.list_(pa.float64()))
    starts, sizes = column.offsets.to_numpy()[:-1], column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    entries = column.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    odd = np.r_[0, np.cumsum(~np.isfinite(entries))]
    good = (sizes > 0) & (odd[starts + sizes] == odd[starts])
    for size in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == size))
        found = entries[starts[rows][:, None] + np.arange(size)]
        yield rows, np.clip(np.floor(SCALE * found) + SHIFT, -_BOUND, _BOUND).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size, i, n, s: for each length how many vectors a task has, and the sum of each dimension."""
    held: dict[int, list] = {}
    for batch in batches:
        for rows, x in matrices(batch.column("v")):
            n, s = held.get(x.shape[1], (0, 0))
            held[x.shape[1]] = (n + len(rows), s + x.sum(axis=0))
    for size, (n, s) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)), pa.array(s)], names=["size", "i", "n", "s"])


def _products(rows: DataFrame, centred) -> np.ndarray:
    """The sum of y y' over all rows, where centred(batch) gives matrices of rows y. Each task hands on its upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for y in centred(batch):
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "p"])

    with shuffles_removed(rows.sparkSession):
        found = rows.mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).toArrow()  # dim * (dim + 1) / 2 rows
    i, j, p = (found.column(c).to_numpy() for c in ("i", "j", "p"))
    out = np.zeros((i.max() + 1, i.max() + 1)) if len(i) else np.zeros((0, 0))
    out[i, j] = out[j, i] = p
    return out


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley steps."""
    size = len(a)
    x, low = a / max(np.linalg.norm(a), 1e-300), 1e-16
    for _ in range(12):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        w = root + np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root), 0.0)) / 2
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(size)]))[0]
        new = b / c * x + (w - b / c) / np.sqrt(c) * q[:size] @ q[size:].T
        new, low = (new + new.T) / 2, min(low * (w + b * low**2) / (1 + c * low**2), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if 1 - low < 1e-14 and moved < 1e-9:
            break
    return x


def _bases(a: np.ndarray, tiny: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below the mean eigenvalue; None where all eigenvalues are equal."""
    size, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(size))
    if spread <= tiny:
        return None
    for nudge in (0, 0.11, -0.17, 0.23, -0.31, 0.37, -0.05, 0.02):  # the mean may be an eigenvalue, which belongs to neither side
        u = polar(a - (mean + nudge * spread / size) * np.eye(size))
        above = (u + np.eye(size)) / 2
        rank = round(np.trace(above))
        if not 0 < rank < size or np.linalg.norm(u @ u - np.eye(size)) > 1e-8 * size:
            continue
        one, two = above @ random.standard_normal((size, rank)), (np.eye(size) - above) @ random.standard_normal((size, size - rank))
        for _ in range(2):
            one, two = np.linalg.qr(above @ one)[0], np.linalg.qr(two - above @ two)[0]
        both = np.linalg.qr(np.hstack([one, two]))[0]
        return both[:, :rank], both[:, rank:]
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    random, size = np.random.default_rng(7), len(a)
    tiny = 4 * np.finfo(float).eps * max(np.linalg.norm(a), 1e-300)
    vectors, open_ = [], [np.eye(size)]
    while open_:
        basis = open_.pop()
        held = basis.T @ a @ basis
        split = _bases((held + held.T) / 2, tiny, random) if basis.shape[1] > 1 else None
        if split is None:
            vectors.append(basis)
        else:
            open_ += [basis @ half for half in split]
    v = np.hstack(vectors)
    for _ in range(2):  # what rounding left beside the diagonal, to first order
        v = np.linalg.qr(v)[0]
        held = v.T @ a @ v
        gap = np.diag(held)[None, :] - np.diag(held)[:, None]
        apart = np.abs(gap) > 1e-6 * np.abs(np.diag(held)).max()
        v = v + v @ np.where(apart, held / np.where(apart, gap, 1), 0)
    v = v / np.linalg.norm(v, axis=0)
    values = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


@dataclass
class Whitener:
    """n vectors with per-dimension sums; unit directions as columns with their eigenvalues; trace of the covariance."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row numbers, x, and x less the mean, of vectors of the fitted length."""
        for rows, x in matrices(column):
            if x.shape[1] == len(self.sums):
                yield rows, x, x - self.sums / self.n

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return y @ (self.directions / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n * x - S)^2, null where they pass 64 bits."""
        most = float(np.abs(x).max(initial=0)) * self.n + float(np.abs(self.sums).max(initial=0))
        off = self.n * x - self.sums if most < 2**62 else self.n * x.astype(object) - self.sums.astype(object)
        far = float(np.abs(off).max(initial=0))
        if most < 2**62 and far * far * x.shape[1] < 2**62:
            return pa.array((off * off).sum(axis=1))
        exact = (off.astype(object) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitener | None:
    """The model of all vectors; None where there is none."""
    rows = vectors.select(F.col(column).alias("v"))
    with shuffles_removed(rows.sparkSession):
        summed = rows.mapInArrow(_sums, "size int, i int, n long, s long").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        sizes = summed.where("i = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).select("size", "n").collect()
        if not sizes:
            return None
        size, n = sizes[0]
        found = summed.where(F.col("size") == size).toArrow()  # a row for each dimension
    sums = np.zeros(size, np.int64)
    sums[found.column("i").to_numpy()] = found.column("s").to_numpy()
    empty = Whitener(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0)
    covariance = _products(rows, lambda batch: (y for _, _, y in empty.centred(batch.column("v")))) / n
    values, directions = eigen(covariance)
    kept = min(components, int((values > size * np.finfo(float).eps * max(values[0], 0)).sum()))
    return Whitener(n, sums, directions[:, :kept], values[:kept], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitener, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over all vectors."""

    def whitened(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, y in model.centred(batch.column("v")):
            w = model.whiten(y)
            yield np.c_[w, np.ones(len(w))]

    found = _products(vectors.select(F.col(column).alias("v")), whitened)
    mean = found[:-1, -1] / model.n
    return float(np.abs(found[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", vec_id: str = "vec_id", components: int = 8) -> DataFrame:
    """One row for each vector that counts and each of its first components."""
    spark, model = vectors.sparkSession, fit(vectors, column, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], _OUT)
    error = identity_error(vectors, model, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, k = [c.split()[0] for c in _OUT.split(", ")], len(model.values)
        for batch in batches:
            for rows, x, y in model.centred(batch.column("v")):
                each = np.repeat(np.arange(len(rows)), k)
                columns = [
                    batch.column("vec_id").take(pa.array(rows)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), model.n)),
                    model.deviation(x).take(pa.array(each)), pa.array(model.whiten(y).ravel()), pa.array(np.tile(model.values / model.trace, len(rows))), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(column).alias("v")).mapInArrow(run, _OUT)
