"""Whitening of embeddings by block Golub-Kahan-Lanczos bidiagonalisation over distributed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.scratch import stored
from rowferry.llm.vectors import floored, matrix, usable
from rowferry.plans.session import ship_package

#: Components that are returned at most; vectors of a block of the bidiagonalisation.
COMPONENTS, BLOCK = 16, 16

#: Parts of the largest squared singular value below which a direction counts as absent.
ABSENT = 1e-14

#: Part of the largest singular value that a residual may have when the iteration ends before its basis is full.
SETTLED = 1e-15

_ROWS = 4096


def whole_rows(vectors: DataFrame, factor: int, offset: int) -> tuple[DataFrame, int]:
    """The rows that take part, as vec_id and x with floor(factor * c) + offset, and the length of x; shorter vectors are filled as with zeros."""
    usable_rows = vectors.where(usable("embedding"))
    width = usable_rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    x = floored("embedding", factor, offset)
    filled = F.concat(x, F.array_repeat(F.lit(offset).cast("bigint"), F.lit(width) - F.size("embedding")))
    return usable_rows.select("vec_id", filled.alias("x")), width


@dataclass(frozen=True)
class Centre:
    """Rows of the fit list, and the sums of their dimensions, exactly."""

    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: 64 bits if they hold it, else Python's integers."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * most < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Sums of squared deviations; null where 64 bits do not hold it."""
        away = self.deviations(x)
        if not away.size:
            return [0] * len(x)
        most = int(np.abs(away).max())
        if most * most * away.shape[1] < 1 << 63:
            return (away.astype(np.int64) ** 2).sum(axis=1).tolist()
        return [s if (s := int(sum(c * c for c in map(int, row)))) < 1 << 63 else None for row in away]


def centre(fit: DataFrame, width: int) -> Centre:
    """The sums are added in Python's integers within a task and as decimals between tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = matrix(batch["x"], width)
            n += len(x)
            small = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0) if small else x.astype(object).sum(axis=0), strict=True)] if len(x) else sums
        yield pa.RecordBatch.from_pydict({"at": list(range(-1, width)), "total": [str(t) for t in (n, *sums)]})

    totals = fit.select("x").mapInArrow(add, "at long, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {row["at"]: int(row["total"]) for row in totals.collect()}  # one row per dimension
    return Centre(found.get(-1, 0), tuple(found.get(i, 0) for i in range(width)))


def summed(fit: DataFrame, width: int, columns: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a product that takes some rows to a matrix: added within tasks, then by rows of the matrix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch["x"], width)
            for at in range(0, len(x), _ROWS):
                part = product(x[at : at + _ROWS])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": list(range(len(total))), "part": total.tolist()})

    parts = fit.select("x").mapInArrow(add, "at long, part array<double>")
    sums = parts.groupBy("at").agg(F.array(*[F.sum(F.get("part", F.lit(j))) for j in range(columns)]).alias("total"))
    found = sums.orderBy("at").collect()  # as many rows as the matrix has
    return np.array([row["total"] for row in found]).reshape(len(found), columns)


def _factor(square: np.ndarray, least: float) -> np.ndarray:
    """What makes vectors with these inner products orthonormal, without directions shorter than the square root of least."""
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    keep = values > least
    return vectors[:, keep] / np.sqrt(values[keep])


def _orthonormal(block: np.ndarray, before: np.ndarray, least: float) -> np.ndarray:
    """The part of the block's columns that the columns before do not span, orthogonalised twice."""
    for _ in range(2):
        block = block - before @ (before.T @ block)
    left, values, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, values > least]
    left = left - before @ (before.T @ left)
    return np.linalg.qr(left)[0]


def decompose(fit: DataFrame, width: int, middle: Centre, block: int = BLOCK, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of the centred rows as columns, and squared singular values, falling.

    A block V of right vectors gives U = X V, made orthonormal against all
    earlier U; X'U gives the next V, made orthonormal against all earlier V. In
    these bases X is block bidiagonal, and its small singular value
    decomposition gives that of X. A row of U is a row of X times a matrix W of
    as many rows as X has columns, so U is not stored: W is, and each product
    with the tall X is one pass over its rows. A second orthogonalisation of U
    takes no pass of its own, as all that is known of U is linear in W.

    The iteration ends when a product brings no new direction, or the residual
    of the wanted components is a rounding error.
    """
    rows = middle.rows
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((width, min(block, width))))[0]
    newest = basis
    w = products = np.empty((width, 0))
    scale = 0.0
    while True:
        # X V, and its inner products with all U so far.
        tall = np.hstack([w, newest])
        inner = summed(fit, width, newest.shape[1], lambda x, m=tall, k=newest.shape[1]: (y := rows(x) @ m).T @ y[:, -k:])
        mixed, square = inner[: w.shape[1]], inner[w.shape[1] :]
        scale = max(scale, float(np.trace(square)))
        new_w = (newest - w @ mixed) @ _factor(square - mixed.T @ mixed, ABSENT * scale)
        if not new_w.shape[1]:
            break
        # X'U, and the inner products once more.
        tall = np.hstack([w, new_w])
        both = summed(
            fit, width, new_w.shape[1],
            lambda x, m=tall, k=new_w.shape[1]: np.vstack([(y := (c := rows(x)) @ m).T @ y[:, -k:], c.T @ y[:, -k:]]),
        )
        mixed, square, product = np.split(both, [w.shape[1], tall.shape[1]])
        again = _factor(square - mixed.T @ mixed, 0.25)
        w, products = np.hstack([w, (new_w - w @ mixed) @ again]), np.hstack([products, (product - products @ mixed) @ again])
        newest = _orthonormal(products[:, -again.shape[1] :], basis, np.sqrt(ABSENT * scale))[:, : width - basis.shape[1]]
        left, values, _ = np.linalg.svd(products.T @ basis)
        residual = np.abs((newest.T @ products) @ left[:, :wanted])
        if not newest.shape[1] or residual.max(initial=0) <= SETTLED * values[0]:
            break
        basis = np.hstack([basis, newest])
    if not w.shape[1]:
        return np.empty((width, 0)), np.empty(0)
    _, values, right = np.linalg.svd(products.T @ basis, full_matrices=False)
    keep = values**2 > ABSENT * values[0] ** 2
    return basis @ right[keep].T, values[keep] ** 2


def whiten(spark: SparkSession, vectors: DataFrame, factor: int = 64, offset: int = 1_000_000, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: one row per row and component.

    The fit list has each vector of whole numbers, floor(factor * c) + offset,
    once, so copies do not weigh. Rows whose vector is null or holds null or
    non-finite entries are dropped; a shorter vector counts as filled with
    zeros; numbers beyond 2^55 count as that. Rows that repeat come out as often.
    deviation is null where 64 bits do not hold it. Directions in which the
    list does not vary are no components, so there are fewer than wanted where
    the list has a lower rank; without rows, or with one vector, there are none.
    A component's largest coordinate is positive. Other columns are not read.
    """
    ship_package(spark)
    rows, width = whole_rows(vectors, factor, offset)
    fit, _ = stored(spark, rows.select("x").distinct(), "whitening-fit")
    middle = centre(fit, width)
    components, squares = decompose(fit, width, middle, wanted=wanted) if middle.n > 1 and width else (np.empty((width, 0)), np.empty(0))
    components, squares = components[:, :wanted], squares[:wanted]
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]) if components.size else np.empty(0)
    n, count = middle.n, len(squares)
    scaled = components * signs / np.sqrt(squares / n) if count else components
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not count:
        return spark.createDataFrame([], schema)
    total, second = np.split(
        summed(fit, width, count, lambda x: np.vstack([np.full(count, ((c := middle.rows(x)) ** 2).sum()), (y := c @ scaled).T @ y])), [1]
    )
    explained = squares / total[0, 0]
    error = float(np.abs(second / n - np.eye(count)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                x = matrix(part["x"], width)
                each = pa.array(np.repeat(np.arange(len(x)), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["vec_id"].take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * count, n)),
                        pa.array(middle.squares(x), pa.int64()).take(each), pa.array((middle.rows(x) @ scaled).ravel()),
                        pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * count, error)),
                    ],
                    [field.strip().split(" ")[0] for field in schema.split(",")],
                )

    return rows.mapInArrow(project, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
