"""Whitening of embeddings: projections on the leading eigenvectors of their covariance, each to variance one.

Entries become whole numbers first (`floor(scale * entry) + offset`), so that sums, means and deviations are exact however
large the offset is beside the spread. The fit list is each distinct vector once. Its covariance is never formed: block
Lanczos asks for its products with a few vectors at a time, and each such pass is one job in which tasks centre their rows,
multiply, and send a block of dimensions by vectors. New blocks are orthogonalised against all earlier ones, twice; where
less than a block is left of a product (breakdown), random directions restart the rest; and where the basis is
full, the best Ritz vectors begin a new one. It ends when the residuals of all wanted eigenvectors are small, or the basis
spans the space. The trace, which makes eigenvalues into shares, is the sum of the rows' deviations.

Cases: vectors that are null or empty, hold null or non-finite entries, or entries of 2 ** 40 or more in magnitude are
dropped, and so are those not of the most frequent length (the greater, if several are); rows with a null id or one id stay, and repeated
vectors count once in the fit; components whose eigenvalue is nothing but rounding have no rows, so a single distinct
vector gives none; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import stage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Magnitude of entries from which on they count as not finite.
LARGEST = float(1 << 40)
#: Vectors that a pass multiplies at once.
BLOCK = 16
#: Vectors that the basis holds before it begins anew from the best of them.
BASIS = 384
#: Residual of an eigenvector by its eigenvalue, and by the largest one times the precision of doubles.
TOLERANCE, FLOOR = 1e-13, 64.0
PASSES = 400
#: Entries that a task holds as numbers at once.
ENTRIES = 1 << 20
EXACT = 1 << 62
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Centred:
    """The exact mean of a fit list, as its size and its sums by dimension."""

    n: int
    sums: list[int]

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: as int64 where it and the sum of its squares fit, else as Python's own numbers."""
        far = max(abs(self.n * int(a) - s) for b in (x.min(0), x.max(0)) for a, s in zip(b, self.sums, strict=True)) if len(x) else 0
        if self.n * int(abs(x).max(initial=0)) < EXACT and max(map(abs, self.sums)) < EXACT and far * far * len(self.sums) < EXACT:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, in doubles."""
        return self.differences(x).astype(np.float64) / self.n


@dataclass
class Whitening:
    """A fitted model; components are rows of a matrix, by falling eigenvalue."""

    centre: Centred
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Ids and whole-number vectors (`x`) of the rows that can be used."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return rows.where((F.size("v") > 0) & fine).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))


def usual_width(rows: DataFrame) -> int | None:
    found = rows.groupBy(F.size("x").alias("wide")).count().orderBy(F.desc("count"), F.desc("wide")).first()
    return found.wide if found else None


def chunks(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with their vectors as a matrix."""
    step = max(1, ENTRIES // wide)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            yield some, some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def centre_of(fit: DataFrame, wide: int) -> Centred:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, [0] * wide
        for _, x in chunks(batches, wide):
            n += len(x)
            found = [a + int(b) for a, b in zip(found, x.sum(0), strict=True)]
        values = pa.array([Decimal(s) for s in [*found, n]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide + 1, dtype=np.int32)), values], names=["cell", "value"])

    rows = fit.mapInArrow(sums, "cell int, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    by_cell = {r.cell: int(r.value) for r in rows}
    return Centred(by_cell[wide], [by_cell[i] for i in range(wide)])


def summed(fit: DataFrame, wide: int, shape: tuple[int, int], work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of work over all runs of rows, a block of the given shape: added up by tasks, then cell by cell."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in chunks(batches, wide):
            total += work(x)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "value"])

    out = np.zeros(shape[0] * shape[1])
    for r in fit.mapInArrow(block, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out.reshape(shape)


def total_deviation(fit: DataFrame, centre: Centred) -> int:
    wide = len(centre.sums)

    def deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(d for _, x in chunks(batches, wide) for d in squares(centre, x).tolist())
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(total)], pa.decimal128(38, 0))], names=["value"])

    return int(fit.mapInArrow(deviations, "value decimal(38,0)").agg(F.sum("value")).first()[0])


def squares(centre: Centred, x: np.ndarray) -> np.ndarray:
    """The deviation of each row: the sum of its squared differences, exact."""
    return (centre.differences(x) ** 2).sum(1)


def orthonormal(block: np.ndarray, basis: np.ndarray, smallest: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal vectors of a block that are orthogonal to the basis too, and random ones in the place of those that aren't left."""
    want, found = min(block.shape[1], len(basis) - basis.shape[1]), basis
    while found.shape[1] - basis.shape[1] < want:
        for _ in range(2):
            block = block - found @ (found.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        kept = left[:, size > smallest][:, : want - found.shape[1] + basis.shape[1]]
        # once more, as little was left of some
        kept = np.linalg.qr(kept - found @ (found.T @ kept))[0]
        found = np.hstack([found, kept])
        block, smallest = rng.standard_normal(block.shape), 1e-8
    return found[:, basis.shape[1] :]


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], wide: int, k: int, block: int = BLOCK, limit: int = BASIS, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric operator and their unit eigenvectors as columns.

    Projections are taken from the kept products of the whole basis, so they and the residuals cost no pass of their own.
    A basis of limit vectors begins anew.
    """
    rng = np.random.default_rng(seed)
    k, block = min(k, wide), min(block, wide)
    limit = min(wide, max(limit, k + 2 * block))
    basis, products = np.zeros((wide, 0)), np.zeros((wide, 0))
    nxt, smallest = rng.standard_normal((wide, block)), 1e-8
    for _ in range(PASSES):
        new = orthonormal(nxt, basis, smallest, rng)
        product = times(new)
        basis, products = np.hstack([basis, new]), np.hstack([products, product])
        inner = basis.T @ products
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, products @ turn
        left = images - vectors * values
        residuals = np.linalg.norm(left, axis=0)[:k]
        largest = max(abs(values).max(), np.finfo(float).tiny)
        enough = np.maximum(TOLERANCE * abs(values[:k]), FLOOR * np.finfo(float).eps * largest)
        if basis.shape[1] == wide or (basis.shape[1] >= k and (residuals <= enough).all()):
            return values[:k], vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
        nxt, smallest = product, 1e-10 * largest
        if basis.shape[1] + block > limit:
            # the best Ritz vectors stay, and their images; what they lack leads on
            basis, products = vectors[:, : k + block], images[:, : k + block]
            nxt, smallest = left[:, :block], 1e-14 * largest
    raise ArithmeticError(f"no convergence within {PASSES} passes")


def fit_whitening(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct vector of rows (`x`) once; None if there are no rows."""
    wide = usual_width(rows)
    if wide is None:
        return None
    fit = stage(rows.where(F.size("x") == wide).select("x").distinct(), "whitening-fit")
    centre = centre_of(fit, wide)

    def times(vectors: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            rows = centre.rows(x)
            return rows.T @ (rows @ vectors)

        return summed(fit, wide, vectors.shape, product) / centre.n

    values, vectors = block_lanczos(times, wide, k)
    trace = float(total_deviation(fit, centre)) / float(centre.n) ** 3
    real = values > 1e-12 * trace
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    model = Whitening(centre, vectors.T.copy(), values, trace, 0.0)
    model.identity_error = identity_error(fit, model)
    return model


def projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    return (model.centre.rows(x) @ model.components.T) / np.sqrt(model.eigenvalues)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the difference between the whitened fit list's covariance and the identity."""
    k, wide, n = len(model.eigenvalues), len(model.centre.sums), model.centre.n
    if not k:
        return 0.0
    mean = summed(fit, wide, (1, k), lambda x: projected(model, x).sum(0, keepdims=True)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        rows = projected(model, x) - mean
        return rows.T @ rows

    return float(abs(summed(fit, wide, (k, k), spread) / n - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row for each row (vec_id, x) and component."""
    wide, k, n = len(model.centre.sums), len(model.eigenvalues), model.centre.n
    shares = model.eigenvalues / model.trace if k else model.eigenvalues

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in chunks(batches, wide):
            each = np.repeat(np.arange(len(x)), k)
            deviation = pa.array([Decimal(int(d)) for d in squares(model.centre, x)], pa.decimal128(38, 0))
            columns = [
                some.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n)),
                deviation.take(pa.array(each)),
                pa.array(projected(model, x).ravel()),
                pa.array(np.tile(shares, len(x))),
                pa.array(np.full(len(each), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    return rows.where(F.size("x") == wide).mapInArrow(project, OUT)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Fit on all vectors and project each of them."""
    rows = quantised(vectors, id_col, vector_col, scale, offset)
    model = fit_whitening(rows, k)
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], OUT)
    return whitened(rows, model)
