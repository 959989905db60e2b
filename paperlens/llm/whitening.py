"""Embedding whitening: components of the covariance by FEAST, and every row projected on them.

1. Every distinct vector counts once: the vectors, as whole numbers, are made distinct (copies meet map-side, before the
   shuffle) and stored.
2. Their number and sums give a whole-number centre; with it one more pass gives the sums of products, in whole numbers.
   Tasks add up their rows and send one row per cell of the matrix, so the driver gets the size of the covariance, which
   the vectors' length bounds, not their number.
3. The covariance, correctly rounded from these sums, goes to `eigen.largest`: contour integration, Rayleigh-Ritz and
   inertia counts.
4. Rows are projected in one pass without a shuffle.  The covariance of the stored vectors' projections, less the identity, tells
   how well they are whitened.

Defined cases: rows with a null vector, or a null or non-finite component, go; all others, with a null or repeated key
too, give one row per component; vectors shorter than the longest end in zeros; vectors without components, or an empty
table, give no row.  A component without variance has whitened null and explained 0 (null if there is no variance
at all).  A deviation that a bigint cannot hold is null.  Other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperlens.llm.common import stored
from paperlens.llm.eigen import largest
from paperlens.llm.vectors import matrix, usable, whole

LONG = 1 << 63


def summed(rows: DataFrame, width: int, cells: int, of_rows) -> list[int]:
    """Sums, over all rows, of the `cells` whole numbers that `of_rows` makes of a matrix of vectors."""

    def run(batches):
        total = [0] * cells
        for batch in batches:
            total = [a + int(b) for a, b in zip(total, of_rows(matrix(batch.column(0), width, np.int64)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(cells), pa.int32()), pa.array(map(str, total), pa.string())], names=["cell", "s"])

    parts = rows.select("x").mapInArrow(run, "cell int, s string").groupBy("cell").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    found = dict(parts.collect())
    return [int(found.get(i, 0)) for i in range(cells)]


def exact(x: np.ndarray, bits: int) -> np.ndarray:
    """Python's numbers where sums of products over the rows may exceed 63 bits."""
    most = max(1, int(np.abs(x).max(initial=0)))
    return x if most**bits * max(1, len(x)) < LONG else x.astype(object)


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, sums per dimension, and covariance (divisor n)."""
    n, *sums = summed(fit, width, width + 1, lambda x: [len(x), *exact(x, 1).sum(axis=0)])
    if not n:
        return 0, sums, np.zeros((width, width))
    centre = [round(Fraction(s, n)) for s in sums]
    upper = np.triu_indices(width)

    def products(x):
        x = exact(exact(x, 1) - np.array(centre, object if max(map(abs, centre), default=0) >= LONG // 2 else np.int64), 2)
        return (x.T @ x)[upper] if x.dtype == object or np.abs(x).max(initial=0) ** 2 * len(x) >= 1 << 53 else (x.T.astype(float) @ x.astype(float))[upper]

    found = summed(fit, width, len(upper[0]), products)
    left = [s - n * c for s, c in zip(sums, centre)]
    v = np.zeros((width, width))
    for i, j, s in zip(*upper, found):
        v[i, j] = v[j, i] = Fraction(n * s - left[i] * left[j], n * n)
    return n, sums, v


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: one row per input row and component."""
    x = rows.filter(usable(vector)).select(F.col(key), whole(vector, scale).alias("x"))
    fit = stored(x.select("x").distinct(), "distinct-vectors")
    width = fit.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums, v = moments(fit, width)
    values, vectors = largest(v, components)
    trace, k = float(np.trace(v)), len(values)
    varies = values > width * np.finfo(float).eps * trace
    turn = vectors[:, varies] / np.sqrt(values[varies])

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - sums, exactly, and the whitened coordinates."""
        size = max(max(map(abs, sums), default=0), n * int(np.abs(x).max(initial=0)))
        away = n * x - np.array(sums) if size < LONG // 2 else n * x.astype(object) - np.array(sums, object)
        return away, (away / max(n, 1)).astype(float) @ turn

    def cells(batches):
        total = np.zeros((len(turn.T) + 1, len(turn.T)))
        for batch in batches:
            w = projected(matrix(batch.column(0), width, np.int64))[1]
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "s"])

    error = 0.0
    if turn.size:
        found = dict(fit.mapInArrow(cells, "cell int, s double").groupBy("cell").agg(F.sum("s")).collect())
        mean, *second = np.array([found[i] for i in range(len(found))]).reshape(-1, len(turn.T)) / n
        error = float(np.abs(np.array(second) - np.outer(mean, mean) - np.eye(len(mean))).max())

    def run(batches):
        for batch in batches:
            away, w = projected(matrix(batch.column(1), width, np.int64))
            if away.size and int(np.abs(away).max()) ** 2 * width >= LONG:
                away = away.astype(object)
            deviation = [int(d) if d < LONG else None for d in (away * away).sum(axis=1)]
            white = np.full((len(away), k), np.nan)
            white[:, varies] = w
            at = np.repeat(np.arange(len(away)), k)
            share = np.where(varies, values / trace, 0.0) if trace > 0 else np.full(k, np.nan)
            columns = [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(away))),
                pa.array(np.full(len(at), n)),
                pa.array(deviation, pa.int64()).take(pa.array(at)),
                pa.array(white.ravel(), from_pandas=True),
                pa.array(np.tile(share, len(away)), from_pandas=True),
                pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return x.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
