"""Embedding whitening (operator 11): exact sums and centred products are gathered from all rows in two
passes, the covariance's largest eigenpairs come from contour integration (eigen_contour), and a third
pass measures the covariance of the whitened rows before a fourth returns them. No pass shuffles rows:
a task sends sums, as many as the vectors have components, squared at most."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eigen_contour import Contour
from .hard_negatives import binary_of, matrix_of
from .runtime import Scratch, usual_length

MOST = 2.0**62
ROWS_AT_ONCE = 2048
#: An eigenvalue below this share of the largest possible one is rounding: its direction holds no variance.
NO_VARIANCE = 2.0**-36


def whole_rows(vectors: DataFrame, scale: int, size: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): rows that take part, components scaled and floored to 64-bit integers."""
    kind = vectors.schema[id_col].dataType
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) > MOST))
    rows = rows.where((F.size("v") == size) & ~odd)

    def floored(batches):
        for b in batches:
            if b.num_rows:
                x = np.floor(b.column("v").flatten().to_numpy().reshape(b.num_rows, size) * scale).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), binary_of(x)], names=["id", "x"])

    return rows.mapInArrow(floored, f"id {kind.simpleString()}, x binary")


def pieces(batches):
    """(batch, integer matrix) of a bounded number of rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            part = b.slice(at, ROWS_AT_ONCE)
            yield part, matrix_of(part.column("x"), np.int64)


def top_of(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def sums_of(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """(number of rows, exact sum of each component)."""

    def add(batches):
        n, total = 0, [0] * size
        for _, x in pieces(batches):
            n += len(x)
            own = x if top_of(x) * len(x) < 1 << 62 else x.astype(object)
            total = [t + int(s) for t, s in zip(total, own.sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "n", "s"])

    held = rows.select("x").mapInArrow(add, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # a row a component
    out = [0] * size
    for r in held:
        out[r.i] = int(r.s)
    return (held[0].n if held else 0), out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they hold it, else Python's."""
    if n * top_of(x) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int | None]:
    """Each row's sum of squares, exact; None where a 64-bit integer cannot hold it."""
    if d.dtype != object and top_of(d) ** 2 * d.shape[1] < 1 << 63:
        return (d**2).sum(1).tolist()
    return [t if (t := sum(int(c) ** 2 for c in row)) < 1 << 63 else None for row in d]


def products_of(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of y y', where y = of(x) is a row's centred vector."""

    def multiply(batches):
        total, any_ = np.zeros((width, width)), False
        for _, x in pieces(batches):
            y, any_ = of(x), True
            total += y.T @ y
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], names=["i", "row"])

    each = rows.select("x").mapInArrow(multiply, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "p"))
    out = np.zeros((width, width))
    for r in each.groupBy("i", "j").agg(F.sum("p").alias("p")).collect():  # an entry of the matrix each
        out[r.i, r.j] = r.p
    return (out + out.T) / 2


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row and component: id, component (from 1, by falling eigenvalue), n, deviation,
    whitened, explained, identity_error. Components are floored after scaling, then x is the vector less the mean
    of all n; deviation is n^2 |x|^2 (exact; null where 64 bits cannot hold it), whitened is x projected on
    the unit eigenvector over the root of its eigenvalue, explained the eigenvalue's share of the trace,
    identity_error the largest entry of the whitened rows' covariance less the identity.

    Rows whose vector is null, holds null or non-finite components or such that scale beyond 2^62, or has another
    length than most vectors are left out. A direction without variance cannot be whitened: a
    table of r independent differences has r components at most, one of equal rows or an empty one gives
    no rows. Repeated rows and ids count as often as they occur; null ids stay; other columns are ignored."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = usual_length(vectors, vector_col)
    if not size:
        return spark.createDataFrame([], schema)
    rows = Scratch(spark).write(whole_rows(vectors, scale, size, id_col, vector_col), "rows")
    n, sums = sums_of(rows, size)
    if not n:
        return spark.createDataFrame([], schema)
    centre = lambda x: centred(x, n, sums).astype(np.float64) / n
    covariance = products_of(rows, size, centre) / n
    trace = float(np.trace(covariance))
    contour = Contour(spark, covariance)
    value, vector = contour.largest(min(components, size), contour.top * NO_VARIANCE) if trace > 0 else (np.zeros(0), None)
    if not len(value):
        return spark.createDataFrame([], schema)
    basis, width = vector / np.sqrt(value), len(value)
    error = float(np.abs(products_of(rows, width, lambda x: centre(x) @ basis) / n - np.eye(width)).max())
    explained = value / trace

    def project(batches):
        for b, x in pieces(batches):
            d = centred(x, n, sums)
            y = (d.astype(np.float64) / n) @ basis
            place = np.repeat(np.arange(len(x)), width)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(place)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))), pa.array(np.full(len(place), n)), pa.array(deviations(d), pa.int64()).take(pa.array(place)), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(place), error))], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
