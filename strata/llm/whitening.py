"""Whitening of embeddings by shifted Cholesky QR.

Rows are centred exactly (integers times their number, less the sum) and their Gram
matrix is summed in the tasks. Its shifted Cholesky factor R1 makes rows that a second
Gram pass finds nearly orthonormal after a triangular solve; passes repeat, shifted while
the Gram matrix is too ill-conditioned to factor as it is, until the rows are orthonormal.
The product of the factors is the R of the centred rows, and its singular value
decomposition has the components: right singular vectors, and squares over n as eigenvalues.

Only matrices of the vectors' width reach the driver, added up in Spark first.

Defined cases: vectors that are null or hold null or non-finite entries are dropped;
shorter ones count as ending in zeros; scaled entries beyond 2**52 count as 2**52. Rows may
repeat and keys may be null. Components stop at the rank of the covariance, so equal
vectors, a single one or an empty table give no rows. Equal eigenvalues leave their
components' order open. Deviations beyond a long are null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import vectors
from strata.llm.common import stored

#: Gram passes at most, and the least eigenvalue at which rows count as orthonormal but for one more factor.
PASSES, ORTHONORMAL = 8, 0.5
#: A Gram matrix below this least share of its largest eigenvalue is factored with a shift.
ILL = 1e-7
#: Singular values below this share of the largest are zero.
RANK = 1e-11
ROUNDING = float(np.finfo(np.float64).eps) / 2


def _sums(rows: DataFrame, width: int) -> tuple[list[int], np.ndarray]:
    """Exact sums of each dimension, and which dimensions vary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = [0] * width, np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
        for b in batches:
            x = vectors.matrix(b.column("vector"), width)
            for part in (x[i : i + 1024] for i in range(0, len(x), 1024)):  # 1,024 entries of at most 2**52 + 10**5 fit a long
                total = [a + int(c) for a, c in zip(total, part.sum(axis=0))]
            if len(x):
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([[Decimal(t) for t in total]], pa.list_(pa.decimal128(38, 0))), pa.array([low.tolist()]), pa.array([high.tolist()])], names=["total", "low", "high"])

    parts = rows.select("vector").mapInArrow(run, "total array<decimal(38,0)>, low array<bigint>, high array<bigint>")
    each = parts.select(F.posexplode(F.arrays_zip("total", "low", "high")).alias("i", "x")).groupBy("i").agg(F.sum("x.total"), F.min("x.low"), F.max("x.high")).orderBy("i").collect()
    return [int(r[1]) for r in each], np.array([r[2] < r[3] for r in each], dtype=bool)


def _solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``q`` with q r = a for an upper triangular ``r``, column by column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, each entry rounded once: the difference n * x - S is exact while it fits a long."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    return ((n * x.astype(object) - sums) / n).astype(np.float64)


def _gram(rows: DataFrame, width: int, size: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of products of rows that ``made`` makes, added up in the tasks and then entry by entry in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            y = made(vectors.matrix(b.column("vector"), width))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total[np.triu_indices(size)].tolist()], pa.list_(pa.float64()))], names=["g"])

    each = rows.select("vector").mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x")).orderBy("i").collect()
    upper = np.zeros((size, size))
    upper[np.triu_indices(size)] = [r[1] for r in each]
    return upper + np.triu(upper, 1).T


def triangular(gram: Callable[[list[np.ndarray]], np.ndarray], n: int, size: int) -> tuple[np.ndarray, int]:
    """R with R'R the Gram matrix of the rows, and the passes made. ``gram`` gives that of the rows after solves with the factors so far."""
    factors: list[np.ndarray] = []
    whole = np.eye(size)
    for done in range(PASSES + 1):
        g = gram(factors)
        values, turned = np.linalg.eigh(g)
        if done and (values[0] >= ORTHONORMAL and values[-1] <= 2 or done == PASSES):
            return (np.sqrt(np.maximum(values, 0))[:, None] * turned.T) @ whole, done + 1
        shift = 11 * (n * size + size * (size + 1)) * ROUNDING * values[-1] if not done or values[0] < ILL * values[-1] else 0.0
        factors.append(np.linalg.cholesky(g + shift * np.eye(size)).T)
        whole = factors[-1] @ whole
    raise AssertionError("the last pass returns")


def whiten(df: DataFrame, components: int = 8, key: str = "vec_id", column: str = "embedding", scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every whole vector and its first ``components`` components."""
    plain = vectors.integers(df, key, column, scale, offset)
    shape = vectors.measured(plain)
    id_type = plain.schema["key"].dataType.simpleString()
    out = f"{key} {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    spark, n, width = df.sparkSession, shape.rows, shape.width
    if not n or not width:
        return spark.createDataFrame([], out)
    rows = stored(vectors.narrowed(plain, shape), "vectors")
    totals, varies = _sums(rows, width)
    sums, size = np.array(totals, dtype=object), int(varies.sum())
    if not size:
        return spark.createDataFrame([], out)

    def orthogonal(factors: list[np.ndarray]) -> np.ndarray:
        def made(x: np.ndarray) -> np.ndarray:
            y = _centred(x, n, sums)[:, varies]
            for r in factors:
                y = _solved(y, r)
            return y

        return _gram(rows, width, size, made)

    r, _ = triangular(orthogonal, n, size)
    _, values, right = np.linalg.svd(r)
    kept = min(components, int((values > RANK * values[0]).sum()))
    axes = np.zeros((width, kept))
    axes[varies] = right[:kept].T
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
    roots, explained = values[:kept] / np.sqrt(n), (values**2 / (values**2).sum())[:kept]
    projected = lambda x: _centred(x, n, sums) @ axes / roots
    error = float(np.abs(_gram(rows, width, kept, projected) / n - np.eye(kept)).max())
    far = max(abs(n * e - s) for e in (shape.low, shape.high) for s in totals)
    small = width * far * far < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x = vectors.matrix(b.column("vector"), width)
                if small:
                    y = n * x - sums.astype(np.int64)
                    deviation = pa.array(np.repeat((y * y).sum(axis=1), kept))
                else:
                    y = n * x.astype(object) - sums
                    deviation = pa.array([v if v < 1 << 63 else None for v in np.repeat((y * y).sum(axis=1), kept)], pa.int64())
                m = len(x) * kept
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("key").take(pa.array(np.repeat(np.arange(len(x)), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)), deviation,
                        pa.array(projected(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(m, error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, out)
