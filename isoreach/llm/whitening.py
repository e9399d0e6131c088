"""Whitening of embeddings by block Lanczos iterations on a distributed product.

The covariance ``V`` is never formed.  A pass over the vectors multiplies it
with a block of columns: each task centres its vectors exactly (whole numbers
minus the whole part of the mean, then its remainder) and sums ``Xc' (Xc B)``;
only dimension x block numbers come back, whatever the number of vectors.  New
blocks are made orthogonal to the whole basis twice; directions that have come to
an end are replaced by random ones (restart on breakdown), and a basis that has
grown long is restarted from its best Ritz vectors.  Iterations end when the
residuals of all wanted eigenpairs are small, or the basis spans the space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.scratch import Scratch

STEPS, OFFSET = 64, 1_000_000  # a value becomes floor(STEPS * value) + OFFSET
TOLERANCE = 1e-13  # residual of an eigenpair, relative to the largest eigenvalue
FLAT = 1e-12  # components whose share of the largest eigenvalue is no more have no spread
BASIS = 8  # blocks that the basis holds before it is restarted
LIMIT = float(1 << 62)


@dataclass(frozen=True)
class Whitening:
    """Components of a list of vectors of whole numbers."""

    n: int
    sums: np.ndarray  # exact, per dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, a column each
    trace: float
    identity_error: float
    passes: int

    def explained(self) -> list[float]:
        """Share of the whole variance by component."""
        return [float(v / self.trace) for v in self.values]


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` with ``x``, the vector in whole numbers, for those that have a finite one.

    Vectors that are null, or hold a null or an entry that is not finite, are
    dropped; so are empty ones.
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    v = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    return rows.where(F.col(f"`{vector}`").isNotNull() & F.forall(v, entry) & (F.size(v) > 0)).withColumn("x", F.transform(v, lambda c: F.floor(c * STEPS) + OFFSET))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy().reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n`` in double precision, without rounding the mean first."""
    return (x - sums // n).astype(float) - (sums % n) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sums over dimensions of ``(n * x - sums) ** 2``; null where 64 bits can't hold one."""
    whole, rest = x - sums // n, sums % n
    if len(x) and (float(np.abs(whole).max()) + 1) ** 2 * float(n) ** 2 * x.shape[1] >= LIMIT:
        exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in whole.tolist()]
        return [e if e < 1 << 63 else None for e in exact]
    y = n * whole - rest
    return (y * y).sum(axis=1).tolist()


def _summed(vectors: DataFrame, part, width: int) -> np.ndarray:
    """The sum over all tasks of a matrix that each task makes of its batches, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = part(_matrix(batch))
                total = made if total is None else total + made
        if total is not None:
            cells = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.from_numpy_dtype(total.dtype)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), cells], names=["i", "row"])

    kind = "double"
    rows = vectors.select("x").mapInArrow(run, f"i long, row array<{kind}>")
    added = rows.groupBy("i").agg(F.array(*[F.sum(F.col("row")[k]) for k in range(width)]).alias("row"))
    out = {r["i"]: r["row"] for r in added.collect()}
    return np.array([out[i] for i in range(len(out))], float)


def product(vectors: DataFrame, n: int, sums: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The covariance times a block of columns, by one pass over the vectors."""

    def part(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, sums)
        return c.T @ (c @ block)

    return _summed(vectors, part, block.shape[1]) / n


def _fresh(rng: np.random.Generator, basis: np.ndarray, block: np.ndarray, width: int, scale: float) -> np.ndarray:
    """Up to ``width`` unit columns orthogonal to ``basis``: those of ``block``, then random ones."""
    out = np.zeros((len(basis), 0))
    for columns, least in ((block, 1e-12 * scale), (rng.standard_normal((len(basis), width)), 1e-6)):
        for _ in range(2):  # full reorthogonalisation, twice is enough
            for held in (basis, out):
                columns = columns - held @ (held.T @ columns)
        u, s, _ = np.linalg.svd(columns, full_matrices=False)
        u = u[:, s > least][:, : min(width, len(basis) - basis.shape[1]) - out.shape[1]]
        for held in (basis, out):
            u = u - held @ (held.T @ u)
        out = np.concatenate([out, u / np.linalg.norm(u, axis=0)], axis=1) if u.shape[1] else out
    return out


def lanczos(multiply, dimension: int, wanted: int, block: int | None = None, tolerance: float = TOLERANCE, seed: int = 5, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray, int]:
    """The greatest eigenpairs of a symmetric matrix that ``multiply`` applies to blocks of columns.

    Returns eigenvalues (falling), unit eigenvectors (columns) and the number
    of products.  The block is as wide as the pairs wanted by default, so that
    equal eigenvalues are all found.
    """
    wanted = min(wanted, dimension)
    width = min(block or wanted, dimension)
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((dimension, 0)), np.zeros((dimension, 0))
    fresh = _fresh(rng, basis, np.zeros((dimension, 0)), width, 1.0)
    for done in range(1, rounds + 1):
        made = multiply(fresh)
        basis, image = np.concatenate([basis, fresh], axis=1), np.concatenate([image, made], axis=1)
        t = basis.T @ image
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        ritz, ritz_image = basis @ y, image @ y
        scale = max(float(np.abs(values).max()), 1e-300)
        residuals = np.linalg.norm(ritz_image - ritz * values, axis=0)
        if basis.shape[1] == dimension or (basis.shape[1] >= wanted and residuals[:wanted].max() <= tolerance * scale):
            return values[:wanted], ritz[:, :wanted] / np.linalg.norm(ritz[:, :wanted], axis=0), done
        fresh = _fresh(rng, basis, made, width, scale)
        if basis.shape[1] + fresh.shape[1] > max(BASIS * width, 2 * wanted + width):
            keep = wanted + width
            basis, image = ritz[:, :keep], ritz_image[:, :keep]
            basis, r = np.linalg.qr(basis)
            image = np.linalg.solve(r.T, image.T).T
    raise RuntimeError(f"residuals stay above {tolerance} after {rounds} products")


def fit(rows: DataFrame, components: int = 32, vector: str = "embedding") -> tuple[Whitening | None, DataFrame]:
    """The components of all vectors, and the table of vectors in whole numbers (``x``) that they hold for.

    All columns of ``rows`` stay in the table but one named ``x``.  Vectors of
    another length than the most frequent one (of several, the longest) are
    dropped.  Without any vector there is no model.  Equal rows all count.
    """
    scratch = Scratch(rows.sparkSession, "whitening")
    vectors = scratch.table(whole_vectors(rows, vector), "vectors")
    sizes = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(2)
    if not sizes:
        return None, vectors
    d, n = sizes[0]["d"], sizes[0]["count"]
    if len(sizes) > 1:
        vectors = vectors.where(F.size("x") == d)
    cells = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    exact = [int(r["s"]) for r in cells.orderBy("i").collect()]
    sums = np.array(exact, object if max(map(abs, exact)) >= 1 << 62 else np.int64)
    if sums.dtype == object:
        raise OverflowError("sums of entries exceed 64 bits")

    def squares(x: np.ndarray) -> np.ndarray:
        return np.array([[float(sum((v or 0) for v in deviations(x, n, sums)))]])

    trace = float(_summed(vectors, squares, 1)[0, 0]) / float(n) ** 3
    values, directions, passes = lanczos(lambda b: product(vectors, n, sums, b), d, components)
    spread = values > FLAT * max(float(values[0]), 0.0)
    values, directions = values[spread], directions[:, spread]
    scaled = directions / np.sqrt(values)

    def gram(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ scaled
        return np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])

    error = 0.0
    if len(values):
        both = _summed(vectors, gram, len(values)) / n
        error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(len(values))).max())
    return Whitening(n, sums, values, directions, trace, error, passes), vectors


def whiten(model: Whitening, vectors: DataFrame) -> DataFrame:
    """``vectors`` (with ``x``) with ``whitened``, a value per component, and ``deviation``; ``x`` is left out."""
    n, sums, scaled = model.n, model.sums, model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            w = centred(x, n, sums) @ scaled
            lists = pa.array(list(w), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(batch.num_columns - 1)], lists, pa.array(deviations(x, n, sums), pa.int64())], names=[*others, "whitened", "deviation"])

    others = [c for c in vectors.columns if c not in ("x", "whitened", "deviation")]
    schema = vectors.select(*[F.col(f"`{c}`") for c in others], F.lit(None).cast("array<double>").alias("whitened"), F.lit(None).cast("long").alias("deviation")).schema
    return vectors.select(*[F.col(f"`{c}`") for c in others], "x").mapInArrow(run, schema)


def report(embeddings: DataFrame) -> DataFrame:
    """One row per vector and component of the embeddings table.

    Components without spread (fewer vectors than dimensions, equal vectors)
    have no rows; an empty table has none at all.
    """
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, vectors = fit(embeddings.select("vec_id", "embedding"))
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], kind)
    rows = whiten(model, vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x"))
    shares = F.array(*[F.lit(v) for v in model.explained()])
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
