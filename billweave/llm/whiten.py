"""Embedding whitening from polarised covariances.

Vectors become whole numbers, ``floor(256 * c)``. The fit list holds each different one once. Two passes over it give, as exact
integers, the number n of vectors and the sums S of the dimensions, and then the sums of squared centred values ``(n x - S)^2`` of
every dimension and of every sum of two dimensions. Half the difference of those variances is the covariance:

    2 cov(a, b) = var(a + b) - var(a) - var(b)

The quotients of integers are rounded once, to a matrix that ``eigh`` takes apart on the driver (one row and column a dimension,
whatever the number of vectors). Tasks square blocks of vectors by machine integers, in two limbs of 20 bits and above where they
would overflow, and by Python's integers beyond 2^42; each adds up its own vectors and returns one row for each sum.

Defined results: rows whose vector is null, or holds null, NaN or an infinity, are dropped; so are vectors of another length than
the commonest one of the fit list (the longer of equals), and empty ones. Numbers beyond 64 bits stop at its ends. A component
whose variance is below 1e-10 of the trace isn't one and gives no row, so that one vector, or equal ones, give no rows; nor does an
empty table. A deviation beyond 64 bits is null. Repeated rows stay repeated, null ids stay, and extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices

SCALE, COMPONENTS = 256, 4
#: Vectors in a block, and the least part of the trace that makes a component.
BLOCK, LEAST = 4096, 1e-10
_LIMB = 20


def whole(vector: Column) -> Column:
    """The vector in whole numbers, null where it isn't finite throughout."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(v, lambda c: F.floor(c * SCALE).cast("long")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``: machine integers where they and sums of two stay below 2^42, else Python's."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if most < 1 << 41:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(c: np.ndarray) -> list[int]:
    """The exact sum of squares of each column, of at most 2^16 numbers below 2^42 or any of Python's."""
    if c.dtype == object:
        return [int(s) for s in (c * c).sum(axis=0)] if len(c) else [0] * c.shape[1]
    high, low = c >> _LIMB, c & ((1 << _LIMB) - 1)
    parts = [np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(a << 2 * _LIMB) + (b << _LIMB + 1) + s for a, b, s in zip(*parts)]


@dataclass
class Whitening:
    """A fitted whitening: its components are columns of ``vectors``."""

    n: int
    sums: list[int]
    variances: np.ndarray
    vectors: np.ndarray
    trace: float
    fit_list: DataFrame


def _added(rows: DataFrame, add: Callable[[dict, np.ndarray], None]) -> dict[tuple[int, int], int]:
    """Sums by a pair of numbers: of each task's vectors, and of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for part in (p for b in batches for p in slices(b, BLOCK)):
            add(sums, _matrix(part["x"]))
        if sums:
            i, j = (pa.array([k[side] for k in sums], pa.int32()) for side in (0, 1))
            yield pa.RecordBatch.from_arrays([i, j, pa.array(map(Decimal, sums.values()), pa.decimal128(38, 0))], ["i", "j", "s"])

    total = rows.mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).toArrow()
    return dict(zip(zip(total["i"].to_pylist(), total["j"].to_pylist()), map(int, total["s"].to_pylist())))


def fit(rows: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the table's vectors; None if there are none."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/whiten-{uuid.uuid4().hex}"
    rows.select(whole(F.col(vec_col)).alias("x")).where("size(x) > 0").distinct().write.parquet(path)
    known = spark.read.parquet(path)
    common = known.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None
    d = common["d"]
    known = known.where(F.size("x") == d)

    def add_up(sums: dict, x: np.ndarray) -> None:
        sums[-1, 0] = sums.get((-1, 0), 0) + len(x)
        exact = x if not len(x) or max(int(x.max()), -int(x.min())) < 1 << 40 else x.astype(object)
        for i, s in enumerate(exact.sum(axis=0).tolist()):
            sums[i, i] = sums.get((i, i), 0) + int(s)

    found = _added(known, add_up)
    n, sums = found[-1, 0], [found[i, i] for i in range(d)]

    def add_squares(squares: dict, x: np.ndarray) -> None:
        c = centred(x, n, sums)
        for i in range(d):  # the dimension itself, and its sums with those after it
            pairs = np.concatenate([c[:, i : i + 1], c[:, i : i + 1] + c[:, i + 1 :]], axis=1)
            for j, s in enumerate(square_sums(pairs), i):
                squares[i, j] = squares.get((i, j), 0) + s

    squares = _added(known, add_squares)
    covariance = np.empty((d, d))
    for i in range(d):
        covariance[i, i] = squares[i, i] / n**3
        for j in range(i + 1, d):
            covariance[i, j] = covariance[j, i] = (squares[i, j] - squares[i, i] - squares[j, j]) / (2 * n**3)
    values, vectors = np.linalg.eigh(covariance)
    trace = sum(squares[i, i] for i in range(d)) / n**3
    chosen = [k for k in range(d - 1, -1, -1) if values[k] > LEAST * trace][:components]
    vectors = vectors[:, chosen]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(chosen))] < 0, -1.0, 1.0)
    return Whitening(n, sums, values[chosen], vectors, trace, known)


def _projected(c: np.ndarray, model: Whitening) -> np.ndarray:
    return (c / model.n).astype(float) @ model.vectors / np.sqrt(model.variances)


def identity_error(model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k, n, plain = len(model.variances), model.n, Whitening(model.n, model.sums, model.variances, model.vectors, model.trace, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((k + 1, k))
        for part in (p for b in batches for p in slices(b, BLOCK)):
            y = _projected(centred(_matrix(part["x"]), plain.n, plain.sums), plain)
            s[:k] += y.T @ y
            s[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k), pa.int32()), pa.array(np.tile(np.arange(k), k + 1), pa.int32()), pa.array(s.ravel())], ["i", "j", "s"])

    s = np.zeros((k + 1, k))
    for row in model.fit_list.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        s[row["i"], row["j"]] = row["s"]
    # the values are centred by exact integers before they are multiplied; what is left of their mean is rounding
    return float(np.abs(s[:k] / n - np.outer(s[k], s[k]) / n**2 - np.eye(k)).max(initial=0.0))


def transform(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each vector and component."""
    key = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return rows.sparkSession.createDataFrame([], schema)
    error, k, d = identity_error(model), len(model.variances), len(model.sums)
    plain = Whitening(model.n, model.sums, model.variances, model.vectors, model.trace, None)
    explained = plain.variances / plain.trace
    x = rows.select(F.col(id_col).alias("vec_id"), whole(F.col(vec_col)).alias("x")).where(F.size("x") == d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, BLOCK)):
            c, m = centred(_matrix(part["x"]), plain.n, plain.sums), part.num_rows
            small = c.dtype != object and d * int(np.abs(c).max()) ** 2 < 1 << 62
            off = (c * c).sum(axis=1) if small else [s if s < 1 << 63 else None for s in (c.astype(object) ** 2).sum(axis=1)]
            each = lambda a, kind: pa.array(np.tile(a, m), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    part["vec_id"].take(pa.array(np.repeat(np.arange(m), k))), each(np.arange(1, k + 1), pa.int32()), pa.array(np.full(m * k, plain.n), pa.int64()),
                    pa.array(off, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(_projected(c, plain).ravel()), each(explained, pa.float64()), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, schema)
