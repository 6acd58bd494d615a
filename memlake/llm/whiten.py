"""Embedding whitening: leading components by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, so counts, sums and deviations are exact. The covariance V over the distinct vectors
is never formed: a pass over the stored fit list centres each row x and adds up ``x (x^T Q)`` for a narrow block Q, so what
a task sends and what the driver holds is the size of Q. A round applies a Chebyshev polynomial of V to the
block by its three-term recurrence, a pass per degree, which damps the part of the spectrum below the
block's smallest Ritz value and lets the part above grow; QR and a Rayleigh-Ritz step follow. The pass of that
step is the first one of the next round. One Lanczos column rides along in the first passes and finds how low the
spectrum goes. The rounds end when the residuals of the wanted pairs certify them to double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.tables import stored

SCALE, SHIFT = 64, 1_000_000
BOUND = 1 << 50  # entries beyond this, scaled, count as this
GUARD = 3  # columns of the block per wanted component
LANCZOS = 12
GROWTH = 1e9  # how far one round may pull the columns of the block apart
ROUNDS = 400
ENTRIES = 1 << 21  # numbers that a task works on at once


def whole(vec: Column) -> Column:
    """Entries as long: ``floor(64 c) + 1000000``."""
    one = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND)))) + F.lit(SHIFT).cast("bigint")
    return F.transform(vec, one)


def finite(vec: Column) -> Column:
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, ENTRIES // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            yield piece, piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, dim)


class Fit:
    """The distinct vectors, with their count and exact sums."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows, dim
        low = SHIFT.bit_length()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((2, dim), np.int64), 0
            for _, x in _matrices(batches, dim):
                n += len(x)
                total += (x >> low).sum(axis=0), (x & (1 << low) - 1).sum(axis=0)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "value"])

        self.n, self.sums = 0, [0] * dim
        for r in rows.mapInArrow(work, "n bigint, value binary").toLocalIterator():
            self.n += r.n
            high, rest = np.frombuffer(r.value, np.int64).reshape(2, dim).tolist()
            self.sums = [s + (h << low) + v for s, h, v in zip(self.sums, high, rest)]
        # The mean as a whole number and a rest below one, so that centring loses nothing.
        self.base = np.array([s // self.n for s in self.sums] if self.n else self.sums, np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums] if self.n else self.sums, np.float64)

    def total(self, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of ``value(centred rows)`` over all rows, divided by their number."""
        dim, base, rest = self.dim, self.base, self.rest

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for _, x in _matrices(batches, dim):
                found = value((x - base) - rest)
                out = found if out is None else out + found
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["value"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for v in b.column("value"):
                    found = np.frombuffer(v.as_buffer(), np.float64)
                    out = found if out is None else out + found
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["value"])

        sums = self.rows.mapInArrow(work, "value binary")
        tasks = self.rows.rdd.getNumPartitions()
        if tasks > 64:  # so that the driver adds up a square root of the tasks
            sums = sums.repartition(math.isqrt(tasks)).mapInArrow(add, "value binary")
        shape = value(np.zeros((1, dim))).shape
        return sum((np.frombuffer(r.value, np.float64) for r in sums.toLocalIterator()), np.zeros(math.prod(shape))).reshape(shape) / max(self.n, 1)

    def times(self, block: np.ndarray) -> np.ndarray:
        """V @ block by one pass."""
        return self.total(lambda c: c.T @ (c @ block))


class LowEnd:
    """Lanczos steps of one column; ``bound`` is a safe estimate of where the spectrum begins."""

    def __init__(self, dim: int, rng: np.random.Generator):
        v = rng.standard_normal(dim)
        self.columns, self.on, self.off = [v / np.linalg.norm(v)], [], []

    @property
    def wanted(self) -> np.ndarray:
        return self.columns[-1][:, None] if len(self.on) < min(LANCZOS, len(self.columns[0])) else np.zeros((len(self.columns[0]), 0))

    def take(self, product: np.ndarray) -> None:
        if product.shape[1]:
            known = np.stack(self.columns, axis=1)
            self.on.append(float(product[:, 0] @ self.columns[-1]))
            left = product[:, 0] - known @ (known.T @ product[:, 0])
            left -= known @ (known.T @ left)
            self.off.append(float(np.linalg.norm(left)))
            self.columns.append(left / max(self.off[-1], np.finfo(float).tiny))

    @property
    def bound(self) -> float:
        if self.wanted.shape[1]:
            return 0.0
        t = np.diag(self.on) + np.diag(self.off[:-1], 1) + np.diag(self.off[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.off[-1])


def leading(times: Callable[[np.ndarray], np.ndarray], dim: int, count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``count`` largest eigenpairs with a value above rounding, by falling value.

    ``times`` multiplies a block by the matrix, which must be symmetric without negative eigenvalues.
    """
    rng = np.random.default_rng([seed, dim])
    ends = LowEnd(dim, rng)
    block = np.linalg.qr(rng.standard_normal((dim, min(dim, GUARD * count))))[0]

    def multiply(y: np.ndarray) -> np.ndarray:
        more = ends.wanted
        product = times(np.hstack([y, more]))
        ends.take(product[:, y.shape[1]:])
        return product[:, :y.shape[1]]

    before = math.inf
    for _ in range(ROUNDS):
        block = np.linalg.qr(block)[0]
        product = multiply(block)
        inner = block.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        top, cut = values[0], values[-1]
        eps = np.finfo(float).eps
        kept = int((values[:count] > 8 * dim * eps * top).sum()) if top > 0 else 0
        if not kept:
            return values[:0], block[:, :0]
        worst = np.linalg.norm(product - block * values, axis=0)[:kept].max()
        # At the level of rounding, or near it and no longer falling.
        if len(values) == dim or worst <= 4 * eps * math.sqrt(dim) * top or (worst <= 1e-12 * top and worst > before / 2):
            vectors = block[:, :kept]
            return values[:kept], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
        before = worst
        low = min(ends.bound, cut * (1 - 1e-6))
        half, centre = max((cut - low) / 2, eps * top), (cut + low) / 2
        degree = int(min(12, max(1, math.log(2 * GROWTH) / math.acosh(max((top - centre) / half, 1 + 1e-6)))))
        # Scaled three-term recurrence; the scale keeps the column of the largest value near one.
        first = ratio = half / (top - centre)
        last, now = block, (product - centre * block) * (ratio / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - ratio)
            last, now = now, (multiply(now) - centre * now) * (2 * after / half) - last * (ratio * after)
            ratio = after
        block = now
    raise RuntimeError(f"components are not certified after {ROUNDS} rounds")


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per usable row and component.

    Vectors that are null or hold null or non-finite entries are left out; shorter vectors are filled with zeros to the
    length of the longest. Null ids and repeated rows are kept; a vector counts once in the fit, however often it
    occurs. Components without spread (fewer distinct vectors or independent dimensions than components) do not exist and
    have no rows, so an empty table or one distinct vector gives none. ``deviation`` is null where it passes a long.
    Entries beyond 2^50 / 64 count as that bound. Other columns are not read.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    good = base.where(finite(F.col("vec"))).select("id", whole(F.col("vec")).alias("x"))
    ends = good.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    schema = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    dim = ends.high or 0
    if not dim:
        return spark.createDataFrame([], schema)
    if ends.low < dim:
        good = good.select("id", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(dim) - F.size("x"))).alias("x"))
    fit = Fit(stored(good.select("x").distinct(), "whiten"), dim)
    n, base_row, rest, sums = fit.n, fit.base, fit.rest, fit.sums
    trace = float(fit.total(lambda c: np.array([(c * c).sum()]))[0])
    values, vectors = leading(fit.times, dim, min(count, dim))
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    turn = vectors / np.sqrt(values)
    error = float(np.abs(fit.total(lambda c: (c @ turn).T @ (c @ turn)) - np.eye(k)).max())
    explained = values / trace

    def deviations(x: np.ndarray) -> pa.Array:
        room = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
        if room < 1 << 62:
            d = n * x - np.array(sums, np.int64)
            if dim * float(np.abs(d).max(initial=0)) ** 2 < 2.0 ** 62:
                return pa.array((d * d).sum(axis=1))
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _matrices(batches, dim):
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [piece.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                 deviations(x).take(each), pa.array((((x - base_row) - rest) @ turn).ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, error))], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(work, schema)
