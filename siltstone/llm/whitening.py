"""Embedding whitening: one pass of rank-one updates per partition, parts merged, eigenvectors by the symmetric QR method.

Each partition's iterator keeps the count, the exact sums, the mean and the centred second moments of the vectors it has
seen (Welford). Parts are merged by the parallel update formula in groups of at most FAN_IN, so that no task and not the
driver holds more than that many matrices; the driver gets one.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c is taken as the integer floor(SCALE * c) + OFFSET; beyond FARTHEST either way, SCALE * c counts as that much.
SCALE, OFFSET, FARTHEST = 1024, 100_000, 1 << 31
COMPONENTS = 8
#: Parts that are merged by one task; the merges' levels do for FAN_IN ** 4 partitions, a million.
FAN_IN_BITS, LEVELS = 5, 3
#: An eigenvalue up to this share of the trace is none.
RANK = 1e-12
_MOMENTS = "part long, n long, sums array<long>, mean array<double>, m2 array<double>"


class Moments:
    """Count, exact sums (of integers), mean and centred second moments of the vectors added so far."""

    def __init__(self, dims: int):
        self.n, self.sums, self.mean, self.m2 = 0, np.zeros(dims, np.int64), np.zeros(dims), np.zeros((dims, dims))

    def add(self, rows: np.ndarray) -> None:
        delta, work = np.empty_like(self.mean), np.empty_like(self.m2)
        for x in rows:
            self.n += 1
            np.subtract(x, self.mean, out=delta)
            self.mean += delta / self.n
            np.multiply(delta[:, None], delta * ((self.n - 1) / self.n), out=work)
            self.m2 += work
        if rows.dtype.kind == "i":
            self.sums += rows.sum(0)

    def merge(self, n: int, sums: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> None:
        if n:
            both, delta = self.n + n, mean - self.mean
            self.m2 += m2 + np.outer(delta, delta) * (self.n * n / both)
            self.mean += delta * (n / both)
            self.sums += sums
            self.n = both

    def row(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [self.n], "sums": [self.sums], "mean": [self.mean], "m2": [self.m2.ravel()]})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    out = Moments(len(pdf["mean"].iloc[0]))
    for part, n, sums, mean, m2 in pdf.sort_values("part").itertuples(index=False):
        out.merge(n, np.asarray(sums), np.asarray(mean), np.asarray(m2).reshape(len(mean), -1))
    return out.row(int(pdf["part"].min()))


def moments(df: DataFrame, dims: int, rows) -> Moments:
    """Moments of the matrices that ``rows`` makes of the Arrow batches of ``df``."""

    def run(batches):
        found = Moments(dims)
        for batch in batches:
            found.add(rows(batch))
        if found.n:
            yield pa.RecordBatch.from_pandas(found.row(TaskContext.get().partitionId()), preserve_index=False)

    parts = df.mapInArrow(run, _MOMENTS)
    for level in range(1, LEVELS + 1):
        parts = parts.groupBy(F.shiftright("part", FAN_IN_BITS * level)).applyInPandas(_merged, _MOMENTS)
    last = parts.groupBy().applyInPandas(_merged, _MOMENTS).first()
    out = Moments(dims)
    if last:
        out.merge(last.n, np.array(last.sums), np.array(last["mean"]), np.array(last.m2).reshape(dims, dims))
    return out


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal, subdiagonal and the rows of the orthogonal transformation."""
    a, n = a.copy(), len(a)
    q, least = np.eye(n), np.finfo(float).eps ** 2 * np.abs(a).max(initial=0)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if np.abs(v[1:]).max() <= least:
            continue
        alpha = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= alpha
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = 2 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = alpha
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return a.diagonal().copy(), a.diagonal(1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and the unit eigenvectors as rows: implicit QR steps with Wilkinson's
    shift on the tridiagonal form."""
    d, e, q = _tridiagonal(np.asarray(a, float))
    eps, hi, steps = np.finfo(float).eps, len(d) - 1, 0
    least = eps**2 * np.abs(a).max(initial=0)

    def small(k):
        return abs(e[k]) <= max(eps * (abs(d[k]) + abs(d[k + 1])), least)

    while hi > 0:
        if small(hi - 1):
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and not small(lo - 1):
            lo -= 1
        steps += 1
        if steps > 60 * len(d):
            raise ArithmeticError("the QR method did not settle")
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dl, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dl, s * s * dk - 2 * c * s * ek + c * c * dl
            e[k] = c * s * (dl - dk) + (c * c - s * s) * ek
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[[k, k + 1]] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order]


def exact(x: np.ndarray) -> np.ndarray:
    """Entries as the integers that are fitted and projected."""
    return np.floor(np.clip(x.astype(float) * SCALE, -FARTHEST, FARTHEST)).astype(np.int64) + OFFSET


@dataclasses.dataclass
class Whitening:
    """A fit over n vectors: their sums, eigenvalues (falling) and unit eigenvectors (rows) of the covariance, its trace."""

    dims: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S) ** 2, exact; None where 64 bits don't hold it."""
        off = x * self.n - self.sums
        rough = (off.astype(float) ** 2).sum(1)
        out = (off * off).sum(1).tolist()
        for i in np.flatnonzero(rough > 2.0**62):
            whole = sum(v * v for v in off[i].tolist())
            out[i] = whole if whole < 1 << 63 else None
        return out


def _usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors without null and non-finite entries that have the most frequent length, and that length."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("size(v) > 0 and forall(v, x -> x is not null and x > double('-infinity') and x < double('infinity'))")
    length = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = length.dims if length else 0
    return rows.where(F.size("v") == dims), dims


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """A fit over ``rows(id, v)``; None if there is none, or no vector differs from another."""
    found = moments(rows.select("v"), dims, lambda batch: exact(_matrix(batch, dims)))
    if not found.n:
        return None
    covariance = found.m2 / found.n
    trace = float(np.trace(covariance))
    values, vectors = symmetric_qr(covariance)
    kept = min(components, int((values > RANK * trace).sum())) if trace > 0 else 0
    return Whitening(dims, found.n, found.sums, values[:kept], vectors[:kept], trace) if kept else None


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, in size, of the whitened vectors' covariance less the identity: a second pass of the same kind."""
    k = len(model.values)
    found = moments(rows.select("v"), k, lambda batch: model.project(exact(_matrix(batch, model.dims))))
    return float(np.abs(found.m2 / found.n - np.eye(k)).max())


def whiten(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those of another length than
    the most frequent (the shorter of two as frequent). Components whose eigenvalue is no more than RANK of the trace
    are left out: a table of equal vectors, of one, or of none gives no rows. Equal eigenvalues leave their vectors'
    directions open, one choice serves all rows. Rows that repeat an id count and appear each; null ids stay. Other
    columns are ignored. The vectors are read four times (length, fit, error, result) and never shuffled.
    """
    rows, dims = _usable(df, id_col, vec_col)
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, [kind.simpleString(), "int", "long", "long", "double", "double", "double"], strict=True))
    model = fit(rows, dims, components) if dims else None
    if model is None:
        return spark.createDataFrame([], schema)
    error, k = identity_error(rows, model), len(model.values)
    shares = model.values / model.trace

    def run(batches):
        for batch in batches:
            x, m = exact(_matrix(batch, dims)), batch.num_rows
            each = np.repeat(np.arange(m), k)
            columns = [
                batch.column("id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(model.project(x).ravel()),
                pa.array(np.tile(shares, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
