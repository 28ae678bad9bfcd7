"""Operator 12: whitening of embeddings along principal components found by Jacobi-Davidson.

Entries become whole numbers, so counts, sums and deviations are exact. The covariance is never
built: a job goes over the rows once for each product of it with a block of a few vectors,
centring every row before it multiplies; Spark adds up the parts, and what reaches the driver is
one small block. The solver keeps an orthonormal subspace, takes Ritz pairs from it, and
extends it by solutions of the projected correction equations, which an inner MINRES solves for
all pairs side by side, so that they share their products. Pairs are locked in falling order
once their residuals are at the rounding of the products; locked ones are projected out.

Defined cases: rows whose vector is null, holds null or a number that is not finite, or an entry
whose whole number has no long, are left out; so are vectors of another length than the
commonest (the longest of equally common ones), for which there is no covariance; a null vec_id
is handed through; repeated rows count and are returned as often; other columns are not looked
at. Components whose variance is zero beside the largest have no whitened value and no row: one
distinct vector, or none, gives no rows. A deviation that does not fit a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm.shared import settle

COMPONENTS = 8
#: Ritz pairs corrected beyond those asked for, dimensions of the subspace before it is restarted, and products of one inner solve.
SPARE, SUBSPACE, INNER = 4, 192, 8
#: A residual is at its rounding below this many units of it; a variance below this share of the largest counts as zero.
ROUNDING, ZERO = 16 * np.finfo(float).eps, 1e-13
OUTER = 200


def whole_vectors(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, the entries as whole numbers, of every row that counts; written to the shared folder."""
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    fits = F.forall("v", lambda c: F.coalesce(F.abs(c * F.lit(1024.0)) < F.lit(2.0**62), F.lit(False)))
    rows = rows.where(fits).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(1024.0)).cast("long") + F.lit(100000)).alias("x"))
    rows = settle(rows)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    return rows.where(F.size("x") == common["d"]) if common else rows


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column as rows of one matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact sum of each dimension over the rows of a task."""
    sums, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            n += len(x)
            fits = not x.size or float(np.abs(x).max()) * len(x) < 2.0**62
            found = (x if fits else x.astype(object)).sum(axis=0).tolist()
            sums = found if sums is None else [a + b for a, b in zip(sums, found)]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(list(map(str, sums))), pa.array([n] * len(sums), pa.int64())], names=["k", "s", "n"])


class Centred:
    """The rows less their mean, as an operator on blocks of vectors that Spark applies."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        cells = rows.select("x").mapInArrow(_sums, "k int, s string, n long").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
        self.n = cells[0]["n"] if cells else 0
        self.sums = [int(x["s"]) for x in sorted(cells, key=lambda x: x["k"])]
        # A mean as a whole number and the rest, so that a row less its mean is rounded once.
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n / self.n for s in self.sums])

    def total(self, part: object) -> dict[int, float]:
        """The sums over all rows of what part makes of each batch of centred rows, by cell."""
        whole, rest = self.whole, self.rest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if batch.num_rows:
                    found = part(_matrix(batch.column(0)) - whole - rest)
                    held = found if held is None else held + found
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size), pa.int64()), pa.array(held.ravel())], names=["cell", "value"])

        cells = self.rows.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        return {x["cell"]: x["value"] for x in cells.collect()}

    def _block(self, part: object, shape: tuple[int, int]) -> np.ndarray:
        found = self.total(part)
        return np.array([found[k] for k in range(shape[0] * shape[1])]).reshape(shape) / self.n

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors."""
        return self._block(lambda x: x.T @ (x @ block), block.shape)

    def trace(self) -> float:
        return float(self._block(lambda x: np.array([[np.sum(x * x)]]), (1, 1))[0, 0])


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns have beyond those they are held against."""
    for _ in range(2):
        for basis in against:
            block = block - basis @ (basis.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        if block.shape[1]:
            left, weight, _ = np.linalg.svd(block, full_matrices=False)
            block = left[:, weight > 1e-10 * max(weight[0], 1e-300)]
    return block


def _corrections(matrix: Centred, locked: np.ndarray, ritz: np.ndarray, values: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """Solutions t of (I-QQ')(A-value)(I-QQ') t = -residual, Q the locked vectors and the pair's own; MINRES for all pairs at once."""

    def projected(block: np.ndarray) -> np.ndarray:
        block = block - locked @ (locked.T @ block)
        return block - ritz * np.sum(ritz * block, axis=0)

    def apply(block: np.ndarray) -> np.ndarray:
        block = projected(block)
        return projected(matrix.product(block) - block * values)

    start = projected(-residuals)
    beta = np.linalg.norm(start, axis=0)
    live = beta > 0
    safe = np.where(live, beta, 1.0)
    v, before = start / safe, np.zeros_like(start)
    x = np.zeros_like(start)
    w, w_before = np.zeros_like(start), np.zeros_like(start)
    c, s, c_before, s_before = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    eta, next_beta = beta.copy(), np.zeros_like(beta)
    for _ in range(INNER):
        p = apply(v)
        alpha = np.sum(v * p, axis=0)
        p = p - v * alpha - before * next_beta
        old = next_beta
        next_beta = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_before * s * old
        first = np.hypot(delta, next_beta)
        second, third = s * alpha + c_before * c * old, s_before * old
        live = live & (first > 0)
        size = np.where(live, first, 1.0)
        c_before, s_before, c, s = c, s, delta / size, next_beta / size
        w, w_before = (v - w_before * third - w * second) / size, w
        x = x + np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        live = live & (next_beta > 1e-14 * np.abs(values)) & (np.abs(eta) > 1e-3 * beta)
        if not live.any():
            break
        before, v = v, p / np.where(next_beta > 0, next_beta, 1.0)
    return projected(x)


def principal_components(matrix: Centred, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest variances in falling order and their unit vectors, as columns, by Jacobi-Davidson."""
    d = len(matrix.sums)
    count = min(count, d)
    locked, values = np.zeros((d, 0)), []
    basis = _orthonormal(np.random.default_rng(1).standard_normal((d, min(d, count + SPARE))))
    images = matrix.product(basis)
    best, stalled = np.inf, 0
    for _ in range(OUTER):
        small = basis.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        top = max([*values, theta[0] if len(theta) else 0.0])
        ritz, image = basis @ turn, images @ turn
        residual = image - ritz * theta
        residual = residual - locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        wanted = count - len(values)
        # Rounding hides what lies below; a residual that no longer falls has met it.
        stalled = stalled + 1 if size[0] > 0.5 * best else 0
        best = min(best, size[0])
        done = 0
        while done < min(wanted, len(theta)) and (size[done] <= ROUNDING * top or done == 0 and stalled > 1 and size[0] <= 100 * ROUNDING * top or basis.shape[1] + len(values) >= d):
            done += 1
        if done:
            locked = np.hstack([locked, ritz[:, :done]])
            values += theta[:done].tolist()
            ritz, image, theta, residual, size = ritz[:, done:], image[:, done:], theta[done:], residual[:, done:], size[done:]
            basis, images, best, stalled = ritz, image, np.inf, 0
        if len(values) >= count or not basis.shape[1] and len(values) >= d:
            break
        if basis.shape[1] > SUBSPACE - count - SPARE:
            basis, images = ritz[:, : 2 * count], image[:, : 2 * count]
        width = min(count - len(values) + SPARE, ritz.shape[1])
        open_ = np.flatnonzero(size[:width] > ROUNDING * top)
        step = _corrections(matrix, locked, ritz[:, open_], theta[open_], residual[:, open_]) if open_.size else np.zeros((d, 0))
        fresh = _orthonormal(step, locked, basis)
        if not fresh.shape[1]:
            fresh = _orthonormal(np.random.default_rng(2 + len(values) + basis.shape[1]).standard_normal((d, 1)), locked, basis)
        if fresh.shape[1]:
            basis, images = np.hstack([basis, fresh]), np.hstack([images, matrix.product(fresh)])
    order = np.argsort(values, kind="stable")[::-1]
    return np.array(values)[order], locked[:, order]


def whiten(embeddings: DataFrame, count: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    fields = [("vec_id", embeddings.schema[vec_id].dataType), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(a, b) for a, b in fields])
    rows = whole_vectors(embeddings, vec_id, vector)
    matrix = Centred(rows)
    if not matrix.sums:
        return spark.createDataFrame([], schema)
    trace = matrix.trace()
    if trace <= 0:
        return spark.createDataFrame([], schema)
    variance, vectors = principal_components(matrix, count)
    keep = variance > ZERO * variance[0]
    variance, vectors = variance[keep], vectors[:, keep]
    turn, k = vectors / np.sqrt(variance), len(variance)
    mean = matrix._block(lambda x: (x @ turn).sum(axis=0)[None], (1, k))[0]

    def spread(x: np.ndarray) -> np.ndarray:
        white = x @ turn - mean
        return white.T @ white

    error = float(np.abs(matrix._block(spread, (k, k)) - np.eye(k)).max())
    n, whole, rest, share = matrix.n, matrix.whole, matrix.rest, variance / trace
    sums = matrix.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            centred = x - whole - rest
            rough = (centred * centred).sum(axis=1) * float(n) ** 2
            if rough.max() < 2.0**62 and np.abs(x).max() * float(n) < 2.0**62 and max(map(abs, sums)) < 2**62:
                apart = n * x - np.array(sums, np.int64)
                far = pa.array((apart * apart).sum(axis=1), pa.int64())
            else:
                exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
                far = pa.array([a if a < 2**63 else None for a in exact], pa.int64())
            size = batch.num_rows
            white = centred @ turn
            each = np.repeat(np.arange(size), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, n, np.int64)),
                    far.take(pa.array(each)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(share, size)),
                    pa.array(np.full(size * k, error)),
                ],
                names=[a for a, _ in fields],
            )

    return rows.select("vec_id", "x").mapInArrow(run, schema)
