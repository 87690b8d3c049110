"""Whitening of embeddings by matrix-free block subspace iteration.

Entries are first put on a grid of whole numbers, x = floor(256 c), so that equal vectors, sums and deviations are
exact. The fit list is each distinct x vector once, found by a shuffle of its own with partial results in each task.
All that is fitted comes from passes over it in which each task multiplies its centred rows: Y = X'(X Q) for a block Q
of a few columns, whose partial products Spark adds up by dimension. The covariance itself is never formed. On the
driver, whose matrices have one row a dimension, each new block is made orthogonal to the search space (QR), and
Rayleigh-Ritz on the space gives the components. Passes go on until the residual |V q - e q| of every component,
from products that Spark has made, is below TOLERANCE times the largest eigenvalue. The space keeps the blocks of
earlier passes, as a spectrum of embeddings is flat and a block alone would take thousands of passes; at MAX_SPACE
columns it starts again from the best Ritz vectors.

Rules: rows whose vector is null or holds nulls, NaN or infinities are dropped, and so are those of another length
than most vectors have (of equally frequent lengths the longer), as they have no place in the space. Entries beyond
64 bits are held at the last whole number. A deviation that needs more than 63 bits is null. Directions without variance
(an eigenvalue below 1e-12 of the largest) are no components, so equal vectors alone give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.llm.common import Scratch, ship_package

SCALE = 256
COMPONENTS = 4
#: Columns of a block beyond the components asked for, and the most columns of the search space.
SPARE = 12
MAX_SPACE = 256
TOLERANCE = 1e-12
MAX_PASSES = 500
ROWS = 8192  # multiplied at once


def usable(vector: Column) -> Column:
    """No null, NaN or infinity in it, and not empty."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def gridded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x) of the usable vectors of the most frequent length."""
    vector = vectors[f"`{vector_col}`"].cast("array<double>")
    rows = vectors.select(vectors[f"`{id_col}`"].alias("id"), F.when(usable(vector), vector).alias("v")).filter("v is not null")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))))
    return rows.filter(F.size("v") == (lengths or 0)).select("id", whole.alias("x"))


def blocks(batches: Iterator[pa.RecordBatch], d: int, column: str = "x") -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """int64 matrices of at most ROWS rows, and the slices that they come from."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            part = whole.slice(at, ROWS)
            yield part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), part


def added_up(fit: DataFrame, work, columns: int) -> np.ndarray:
    """The sum over tasks of matrices that work(batches) makes, row by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = work(batches)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), *(pa.array(c) for c in out.T)], names=["i", *(f"y{j}" for j in range(columns))])

    parts = fit.mapInArrow(run, "i int, " + ", ".join(f"y{j} double" for j in range(columns)))
    rows = parts.groupBy("i").agg(*(F.sum(f"y{j}").alias(f"y{j}") for j in range(columns))).collect()  # one row a dimension
    return np.array([r[1:] for r in sorted(rows)], float)


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums by dimension; vectors (a column each) and values of the components; the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def sums_of(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """The number of rows and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, low = [0] * d, 0, 1 << 31
        for x, part in blocks(batches, d):
            high = x >> 31  # two sums of 31 and 33 bits a value, so that none wraps
            total = [t + int(h) * low + int(r) for t, h, r in zip(total, high.sum(0), (x - (high << 31)).sum(0))]
            n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in [n, *total]])], names=["i", "s"])

    rows = fit.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    found = [int(r.s) for r in sorted(rows, key=lambda r: r.i)]
    return (found[0], tuple(found[1:])) if found else (0, ())


def product(fit: DataFrame, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(X'(X q), the sum of all squares) of the centred rows: one pass."""
    d, columns = q.shape

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out, squares, some = np.zeros((d, columns)), 0.0, False
        for x, _ in blocks(batches, d):
            centred = x - mean
            out += centred.T @ (centred @ q)
            squares += float((centred * centred).sum())
            some = True
        return np.vstack([out, np.full((1, columns), squares)]) if some else None

    found = added_up(fit, work, columns)
    return found[:-1], float(found[-1, 0])


def orthogonal(block: np.ndarray, space: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to an orthonormal space: projected twice, then QR; what is lost in rounding goes."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - space @ (space.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block


def identity_gap(fit: DataFrame, mean: np.ndarray, scaled: np.ndarray, n: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity: one pass."""
    d, k = scaled.shape

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out, some = np.zeros((k + 1, k)), False
        for x, _ in blocks(batches, d):
            white = (x - mean) @ scaled
            out += np.vstack([white.T @ white, white.sum(0)])
            some = True
        return out if some else None

    found = added_up(fit, work, k) / n
    return float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(k)).max())


def fit_components(fit: DataFrame, components: int = COMPONENTS, max_space: int = MAX_SPACE, tolerance: float = TOLERANCE) -> Whitening | None:
    """The components of distinct grid vectors (x), certified by their residuals; None if there are none."""
    ship_package(fit.sparkSession)
    first = fit.select("x").first()
    if first is None:
        return None
    d = len(first.x)
    n, sums = sums_of(fit, d)
    mean = np.array([s / n for s in sums])
    wide = min(d, components + SPARE)
    max_space = max(max_space, 2 * wide)
    # X and V X have one column a searched direction; V stands for the covariance, of which only products are known.
    space, image = np.zeros((d, 0)), np.zeros((d, 0))
    block, trace = np.linalg.qr(np.random.default_rng(0).standard_normal((d, wide)))[0], 0.0
    for passes in range(1, MAX_PASSES + 1):
        made, squares = product(fit, mean, block)
        space, image, trace = np.hstack([space, block]), np.hstack([image, made / n]), squares / n
        if trace == 0:
            return None
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, ritz_image = space @ turn, image @ turn
        gaps = ritz_image - ritz * values
        k = min(components, len(values))
        worst = float(np.linalg.norm(gaps[:, :k], axis=0).max())
        if worst <= tolerance * values[0] and (k == components or space.shape[1] == d):
            break
        if space.shape[1] + wide > max_space:
            space, image = ritz[:, :wide], ritz_image[:, :wide]
            space, r = np.linalg.qr(space)
            image = np.linalg.solve(r.T, image.T).T
        block = orthogonal(gaps[:, :wide], space)
        if not block.shape[1]:
            block = orthogonal(np.random.default_rng(passes).standard_normal((d, min(wide, d - space.shape[1]))), space)
        if not block.shape[1]:  # the space is all there is: its Ritz pairs are exact but for rounding
            break
    else:
        raise RuntimeError(f"the residual is {worst:g} after {MAX_PASSES} passes")
    real = values[:k] > 1e-12 * values[0]
    vectors, values = ritz[:, :k][:, real], values[:k][real]
    gap = identity_gap(fit, mean, vectors / np.sqrt(values), n)
    return Whitening(n, sums, vectors, values, trace, gap, worst, passes)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """The sum over dimensions of (n x - S)^2 of each row, exactly; null beyond 63 bits."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        off = x * n - np.array(sums, np.int64)
        return pa.array((off * off).sum(1))
    exact = [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(id, deviation, white): the coordinates of each row of (id, x) on all components, each of variance one over the fit list."""
    kind = rows.schema["id"].dataType.simpleString()
    if model is None:
        return rows.limit(0).select("id", F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("white"))
    n, sums, d, mean, scaled = model.n, model.sums, len(model.sums), model.mean, model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, part in blocks(batches, d):
            white = (x - mean) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, scaled.shape[1], dtype=np.int32)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), deviations(x, n, sums), lists], names=["id", "deviation", "white"])

    return rows.mapInArrow(run, f"id {kind}, deviation long, white array<double>")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, max_space: int = MAX_SPACE) -> tuple[DataFrame, Whitening | None]:
    """The usable rows on the components (id, deviation, white), and the model."""
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.saved(gridded(vectors, id_col, vector_col))
    model = fit_components(scratch.saved(rows.select("x").distinct()), components, max_space)
    return whiten(rows, model).withColumnRenamed("id", id_col), model
