"""Embedding whitening by a two-pass covariance.

Entries become whole numbers x = floor(SCALE * c) + OFFSET. The first pass sums them exactly, so that the mean S / n is known without an error.
The second sums outer products of the centred rows, (n * x - S) / n with the numerator exact, by one matrix product for each batch; tasks'
sums are merged by treeAggregate, and LAPACK's symmetric solver takes the covariance apart on the driver. Both are of the size of the
vectors' dimension, squared, whatever the number of rows. The projection is broadcast: of the same size. A third pass measures what the result
is worth: the covariance of the whitened values themselves, summed about each task's own mean and merged pairwise.

Left out: null vectors, those that hold nulls, NaN or infinities, or entries whose x isn't a 64-bit number; those of another length than most
have (of equally many the shorter), empty ones too. Equal vectors and repeated or null ids are rows of their own. Directions without variance
(eigenvalues of at most RANK of the greatest) are no components: few rows, or equal ones, give fewer components, one row or none gives no
result rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SCALE, OFFSET = 64, 1_000_000
#: Eigenvalues up to this part of the greatest count as zero.
RANK = 1e-10
#: Rows that meet in one matrix product.
ROWS = 4096
_LIMIT = float(1 << 62)


@dataclass
class Fit:
    """n vectors with exact sums; components as columns, with their eigenvalues, by falling eigenvalue; the covariance's trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)


def _usable(column: pa.Array, dim: int) -> np.ndarray:
    """Row numbers of the vectors of length ``dim`` that hold numbers alone."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(sizes == dim)


def _whole(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of usable rows with their x as whole numbers. The vectors are in the last column."""
    for b in slices(batches, ROWS):
        rows = _usable(b.column(b.num_columns - 1), dim)
        if not len(rows):
            continue
        b = b.take(pa.array(rows))
        flat = b.column(b.num_columns - 1).flatten()
        entries = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(entries * float(SCALE))
            good = (np.abs(scaled) < _LIMIT).all(1)  # false for NaN and infinities
        if good.all():
            yield b, scaled.astype(np.int64) + OFFSET
        elif good.any():
            yield b.filter(pa.array(good)), scaled[good].astype(np.int64) + OFFSET


def _sum(x: np.ndarray) -> list[int]:
    """Exact column sums: high and low halves can't overflow."""
    return [(int(h) << 31) + int(l) for h, l in zip((x >> 31).sum(0), (x & ((1 << 31) - 1)).sum(0))]


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit where they fit, else Python's whole numbers."""
    whole = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole)]
    if max((abs(w) for w in whole), default=0) < 1 << 62:
        near = x - np.array(whole, np.int64) if np.abs(x).max(initial=0) < 1 << 61 and max((abs(w) for w in whole), default=0) < 1 << 61 else None
        if near is not None and int(np.abs(near).max(initial=0)) * n + n < 1 << 62:
            return near * n - np.array(rest, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(d: np.ndarray) -> list[int]:
    """Sums of squares of each row, exact: numbers are squared in pieces of 21 bits where the plain squares wouldn't fit."""
    if d.dtype == object:
        return [sum(v * v for v in row) for row in d.tolist()]
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] < 1 << 62:
        return (d * d).sum(1).tolist()
    a = np.abs(d)
    p = [(a >> (21 * k)) & ((1 << 21) - 1) for k in range(3)]
    return [sum(int(v) << (21 * s) for s, v in zip((0, 1, 2, 2, 3, 4), row)) for row in zip((p[0] * p[0]).sum(1), 2 * (p[0] * p[1]).sum(1), 2 * (p[0] * p[2]).sum(1), (p[1] * p[1]).sum(1), 2 * (p[1] * p[2]).sum(1), (p[2] * p[2]).sum(1))]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once."""
    return _numerators(x, n, sums).astype(np.float64) / n


def _rows(df: DataFrame, vector_col: str, id_col: str | None = None) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>").alias("vector")
    return df.select(vector) if id_col is None else df.select(F.col(id_col).alias("id"), vector)


def _moments(rows: DataFrame, dim: int, n: int, sums: list[int], basis: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and summed centred outer products: of the exactly centred x or, with a basis, of what it makes of them, about
    each batch's own mean."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _whole(batches, dim):
            c = _centred(x, n, sums)
            if sent.value is not None:
                c = c @ sent.value
                mean = c.mean(0)
                part = (len(c), mean, (c - mean).T @ (c - mean))
            else:
                part = (len(c), np.zeros(dim), c.T @ c)
            total = part if total is None else merged(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), pa.array([total[1].tobytes()], pa.binary()), pa.array([total[2].tobytes()], pa.large_binary())], names=["n", "mean", "products"])

    size = dim if basis is None else basis.shape[1]
    zero = (0, np.zeros(size), np.zeros((size, size)))
    parts = rows.mapInArrow(run, "n long, mean binary, products binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1]), np.frombuffer(r[2]).reshape(size, size)))
    return parts.treeAggregate(zero, merged, merged, depth=_depth(rows))


def _depth(rows: DataFrame) -> int:
    """Levels of the tree: up to 32 matrices meet at a time."""
    n, depth = max(rows.rdd.getNumPartitions(), 1), 2
    while 32**depth < n:
        depth += 1
    return depth


def merged(a, b):
    """Counts, means and centred products of two sets of rows together."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * (b[0] / n))


def fit(vectors: DataFrame, *, vector_col: str = "embedding") -> Fit | None:
    """The fit over all usable vectors, None where there are none. Reads ``vectors`` three times: store what is costly to compute."""
    rows = _rows(vectors, vector_col)
    lengths = rows.filter("size(vector) > 0").groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not lengths:
        return None
    dim = lengths[0]["dim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for _, x in _whole(batches, dim):
            n, sums = n + len(x), [s + t for s, t in zip(sums, _sum(x))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["n", "sums"])

    parts = rows.mapInArrow(run, "n long, sums array<string>")
    exact = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    if not exact:
        return None
    n, sums = exact[0]["n"], [int(r["s"]) for r in exact]
    _, _, products = _moments(rows, dim, n, sums)
    covariance = products / n
    values, basis = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > max(values.max(), 0.0) * RANK]
    return Fit(n, sums, basis[:, order], values[order], float(np.trace(covariance)))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """id, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error: a row for each usable vector, with
    ``most`` components or as many as there are."""
    spark = vectors.sparkSession
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    found = fit(vectors, vector_col=vector_col)
    if found is None or not len(found.values):
        return spark.createDataFrame([], schema)
    n, sums, dim = found.n, found.sums, found.dim
    basis = found.vectors[:, :most] / np.sqrt(found.values[:most])
    explained = (found.values[:most] / found.trace).tolist()
    count, _, products = _moments(_rows(vectors, vector_col), dim, n, sums, basis)
    error = float(np.abs(products / count - np.eye(basis.shape[1])).max())
    sent = spark.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _whole(batches, dim):
            d = _numerators(x, n, sums)
            white = (d.astype(np.float64) / n) @ sent.value
            ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], pa.int32())
            texts = [str(v) for v in _deviations(d)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], names=["id", "deviation", "whitened"])

    kind = vectors.schema[id_col].dataType.simpleString()
    out = _rows(vectors, vector_col, id_col).mapInArrow(run, f"id {kind}, deviation string, whitened array<double>")
    return out.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), "whitened", F.lit(explained).alias("explained"), F.lit(error).alias("identity_error"))


def components(white: DataFrame, *, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1. ``deviation`` as a 64-bit number; null where it doesn't fit."""
    return white.select(
        id_col, "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "identity_error"
    ).select(id_col, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
