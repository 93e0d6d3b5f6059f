"""Principal components of vectors, scaled to variance one, from partition moments merged pairwise.

Every partition gives the count, mean and centred scatter of its vectors; Chan's
formula merges two of these exactly as if their vectors had been centred together,
in a tree of tasks. The driver sees one matrix of the dimension squared. A second
pass over the vectors measures how far the whitened ones are from the identity.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_materialized, in_worker, materialize

#: Entries become floor(SCALE * entry) + SHIFT; those beyond MOST in size count as MOST.
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 62
COMPONENTS = 16
#: Vectors whose products are formed together.
ROWS = 4096
MOMENTS = "n long, sums binary, mean binary, scatter binary"


@dataclass
class Moments:
    """Count, exact sums (Python integers, else None), mean and centred scatter of some vectors."""

    n: int
    sums: np.ndarray | None
    mean: np.ndarray
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        """Chan's pairwise formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, None if self.sums is None else self.sums + other.sums, self.mean + gap * (other.n / n), scatter)


def moments_of(x: np.ndarray) -> Moments:
    """Of the rows of a matrix. Of integers the sums are exact, and means are from SHIFT on, about which scaled entries lie."""
    exact = None
    if x.dtype == np.int64:
        low = x & 0xFFFFFFFF  # so that sums of halves can't overflow
        exact = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)
        x = (x - SHIFT).astype(float)
    mean = x.mean(axis=0)
    centred = x - mean
    return Moments(len(x), exact, mean, centred.T @ centred)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The lists of a column, which have one length and no nulls, as a matrix."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def merge_moments(vectors: DataFrame, transform=None) -> Moments:
    """Moments of the first column of ``vectors`` (arrays of one length), or of ``transform`` of their matrix; of at least one row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(k, ROWS), np.int64)
                new = moments_of(x if transform is None else transform(x))
                held = new if held is None else held.merged(new)
        if held is not None:
            sums = b"" if held.sums is None else " ".join(map(str, held.sums)).encode()
            yield pa.RecordBatch.from_arrays([pa.array([held.n]), pa.array([sums], pa.binary()), pa.array([held.mean.tobytes()], pa.binary()), pa.array([held.scatter.tobytes()], pa.binary())], names=["n", "sums", "mean", "scatter"])

    def load(row) -> Moments:
        mean = np.frombuffer(row["mean"])
        return Moments(row["n"], np.array([int(s) for s in bytes(row["sums"]).split()], object) if row["sums"] else None, mean, np.frombuffer(row["scatter"]).reshape(len(mean), -1))

    return vectors.mapInArrow(in_worker(partial), MOMENTS).rdd.map(load).treeReduce(Moments.merged)


@dataclass
class Whitening:
    """What a fit gives: count and exact sums of the fit list, projection (a column a component, scaled), shares of variance, and the identity's error."""

    n: int
    sums: np.ndarray
    projection: np.ndarray
    scaled: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Components by row, in units of their deviation; of components without variance, zero."""
        whole, left = self._mean()
        return ((x - whole) - left / self.n) @ self.projection

    def _mean(self) -> tuple[np.ndarray, np.ndarray]:
        """S / n, exactly: whole numbers and what is left of n."""
        return tuple(np.array([f(int(s), self.n) for s in self.sums], np.int64) for f in (operator.floordiv, operator.mod))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n * x - S)^2 by row; None where it is no 64-bit integer."""
        whole, left = self._mean()
        off = x - whole
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((off * self.n - left) ** 2).sum(axis=1).tolist()
        wide = (((off.astype(object) * self.n - left.astype(object)) ** 2).sum(axis=1)).tolist()
        return [v if v < 1 << 63 else None for v in wide]


def decompose(moments: Moments, components: int) -> Whitening:
    """Unit eigenvectors of the covariance by falling eigenvalue, the first ``components`` of them."""
    cov = moments.scatter / moments.n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    values, kept = np.maximum(values, 0), min(components, len(values))
    real = values > (values[0] if len(values) else 0) * len(values) * np.finfo(float).eps  # the others are zero up to rounding
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0)[:kept]
    total = values.sum()
    return Whitening(moments.n, moments.sums, vectors[:, :kept] * scale, real[:kept], np.where(real, values, 0)[:kept] / (total if total else 1))


def whole_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with __x, the scaled entries; without rows whose vector is null or holds null or non-finite entries."""
    entries = F.col(vector).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = float(MOST - (1 << 30))  # so that SHIFT can be added
    scaled = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(bound)), F.lit(-bound))) + SHIFT)
    return rows.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0)).withColumn("__x", scaled)


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening, int] | None:
    """The whitening of the distinct scaled vectors of ``rows``, and their dimension; None without vectors.

    The dimension is the one that most distinct vectors have, of several the
    larger. The distinct vectors are written once and read for both passes.
    """
    distinct = materialize(whole_vectors(rows.select(vector), vector).select("__x").distinct(), "vectors")
    try:
        sizes = distinct.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if sizes is None:
            return None
        same = distinct.where(F.size("__x") == sizes["d"])
        whitening = decompose(merge_moments(same), components)
        seen = merge_moments(same, whitening.whiten)
        off = np.abs(seen.scatter / seen.n - np.eye(len(seen.mean)))[np.ix_(whitening.scaled, whitening.scaled)]
        whitening.identity_error = float(off.max(initial=0))
        return whitening, sizes["d"]
    finally:
        drop_materialized(distinct)


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector of ``rows`` and component up to ``components`` (or the dimension, if that is less).

    Entries c become x = floor(64 * c) + 1,000,000 and stop at 2^62 in size. The
    components are the unit eigenvectors of the covariance of the distinct x
    vectors, from 1 by falling eigenvalue. Returns ``key``, component, n (distinct
    vectors), deviation (exact sum over dimensions of (n * x - S)^2, null beyond 64
    bits), whitened, explained (share of all variance) and identity_error (largest
    entry of the whitened covariance minus the identity, over components that have
    variance).

    Rows whose vector is null, empty or holds null or non-finite entries are left
    out, as are those of another dimension than most distinct vectors have (ties:
    the larger). A component without variance is 0 in whitened and explained.
    Repeated rows count once in the fit and give repeated results; a null key stays
    null; other columns are not read. Without vectors the result is empty.
    """
    found = fit(rows, vector, components)
    kind = rows.schema[key].dataType.simpleString()
    if found is None:
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, {OUT}")
    whitening, dimension = found
    narrow = whole_vectors(rows.select(key, vector), vector).where(F.size("__x") == dimension).select(key, "__x")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = whitening.projection.shape[1]
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                x = _matrix(part.column(1), np.int64)
                rows_of = np.repeat(np.arange(len(x)), kept)
                each = lambda v: pa.array(np.tile(v, len(x)))
                columns = [
                    part.column(0).take(pa.array(rows_of)), each(np.arange(1, kept + 1, dtype=np.int32)), pa.array(np.full(len(rows_of), whitening.n)),
                    pc.take(pa.array(whitening.deviations(x), pa.int64()), pa.array(rows_of)), pa.array(whitening.whiten(x).ravel()), each(whitening.explained),
                    pa.array(np.full(len(rows_of), whitening.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return narrow.mapInArrow(in_worker(project), f"{key} {kind}, {OUT}")
