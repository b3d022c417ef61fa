"""Whitening of embeddings: components of their covariance, each brought to variance one.

Components of a vector become whole numbers, so sums are exact. The covariance is fitted to every distinct vector once: they
are centred, multiplied in the tasks, and the products of all tasks are added up. Its eigenvectors, a matrix of the size of
one dimension squared, are the only thing that the driver works out (``eigen``) and sends back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsignal.llm.blobs import bounded_records
from gridsignal.llm.eigen import eigenvectors
from gridsignal.session import settle

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
MAX_DIMENSIONS = 4096  # the driver holds a few matrices of this size
LARGEST = 2.0**62  # entries beyond it count as this, so that they fit a long

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(df: DataFrame, id: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: rows whose vector has no null or non-finite entry, with ``floor(scale * c) + shift`` for entry ``c``.

    Vectors have the most frequent length of these (of equally frequent ones the largest); others take no part.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.where(v.isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(v) > 0)).select(F.col(f"`{id}`").cast("long").alias("vec_id"), v.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions are more than the {MAX_DIMENSIONS} of which the driver can hold a square matrix")

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c * scale, F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(shift).cast("long")

    return rows.where(F.size("v") == d).select("vec_id", F.transform("v", whole).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), dtype=np.int64).reshape(len(column), -1)


@dataclass
class Whitening:
    """``n`` distinct vectors with the exact sums ``total``; unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - total``, whole numbers: longs while these hold them, else Python's."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, 0) + max(map(abs, self.total), default=0)
        if largest < 1 << 62:
            return x * self.n - np.array(self.total, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.total, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of the squares of ``scaled``; null where a long cannot hold it."""
        away = self.scaled(x)
        about = (away.astype(np.float64) ** 2).sum(axis=1)
        if away.dtype != object and about.max(initial=0.0) < 2.0**62:
            return pa.array((away * away).sum(axis=1), pa.int64())
        exact = [sum(int(a) ** 2 for a in row) for row in away]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections on the components over the root of their eigenvalue; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centred(x) @ self.vectors / np.sqrt(self.values), np.nan)


def exact_totals(fit_list: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and their exact sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                # halves of the numbers cannot overflow
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                part = [(int(h) << 32) + int(lo) for h, lo in zip(high, low)]
                total, n = part if total is None else [a + b for a, b in zip(total, part)], n + batch.num_rows
        if total is not None:
            rows = [{"at": i, "total": t} for i, t in enumerate([n, *total])]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("at", pa.int32()), ("total", pa.decimal128(38, 0))]))

    sums = bounded_records(fit_list.select("x")).mapInArrow(add, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total"))
    found = {r["at"]: int(r["total"]) for r in sums.collect()}  # one row per dimension
    return found.get(0, 0), [found[i] for i in range(1, len(found))]


def gram(fit_list: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the products of the columns of ``of(x)`` over all vectors: added up in tasks, then row by row of the matrix."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = of(matrix(batch.column(0)))
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "line": pa.array(list(total), pa.list_(pa.float64()))})

    def add(parts: pa.Table) -> pa.Table:
        line = np.asarray(pc.list_flatten(parts["line"])).reshape(parts.num_rows, -1).sum(axis=0)
        return pa.table({"at": parts["at"][:1], "line": pa.array([line], pa.list_(pa.float64()))})

    schema = "at int, line array<double>"
    lines = bounded_records(fit_list.select("x")).mapInArrow(multiply, schema).groupBy("at").applyInArrow(add, schema).collect()  # one row per dimension
    return np.array([r["line"] for r in sorted(lines, key=lambda r: r["at"])])


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening fitted to the vectors ``x`` of ``fit_list`` as they are; none without vectors."""
    n, total = exact_totals(fit_list)
    if not n:
        return None
    blank = Whitening(n, total, np.zeros(0), np.zeros((len(total), 0)), np.zeros(0))
    covariance = gram(fit_list, blank.centred) / n
    values, vectors = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    explained = values / trace if trace > 0 else np.zeros(len(values))
    # what is left of a variance of zero after rounding
    values = np.where(values > values.max(initial=0.0) * len(values) * np.finfo(np.float64).eps, values, 0.0)
    return Whitening(n, total, values[:components], vectors[:, :components], explained[:components])


def identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components with a variance."""
    real = model.values > 0
    if not real.any():
        return None
    sums = gram(fit_list, lambda x: np.column_stack([model.whitened(x)[:, real], np.ones(len(x))]))
    mean = sums[-1, :-1] / model.n
    return float(np.abs(sums[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(int(real.sum()))).max())


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of another than the most
    frequent length. A vector that many rows have counts once in the fit, and every row has its result; null ids stay null.
    ``deviation`` is null where a long cannot hold it. A component without variance (as with a single vector) has
    ``whitened`` null and ``explained`` 0 and does not count in ``identity_error``, which is null without any other. An
    empty table gives no rows. Other columns are not read. Runs jobs when called.
    """
    rows = whole_vectors(df, id, vector, scale, shift)
    fit_list = settle(rows.select("x").distinct())
    model = fit(fit_list, components)
    if model is None:
        return df.sparkSession.createDataFrame([], RESULT)
    error = identity_error(fit_list, model)
    count = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column(1))
            each = np.repeat(np.arange(n), count)
            white = model.whitened(x).ravel()
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), n)),
                "n": pa.array(np.full(n * count, model.n)), "deviation": model.deviation(x).take(pa.array(each)),
                "whitened": pa.array(white, mask=np.isnan(white)), "explained": pa.array(np.tile(model.explained, n)),
                "identity_error": pa.array([error] * (n * count), pa.float64()),
            })

    return bounded_records(rows).mapInArrow(project, RESULT)
