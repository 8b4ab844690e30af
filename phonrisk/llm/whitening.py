"""Whitening of embeddings by shifted CholeskyQR.

The centred rows ``X`` (n by D) are orthogonalised without ever being gathered. Each round is one
distributed pass: tasks solve their rows against the triangular factors found so far and add up the
Gram matrix of the results; its Cholesky factor (with a shift on the diagonal while the Gram matrix is
far from the identity, so that an ill-conditioned one can be factored) is the next triangle. The first
round shifts and tames the condition, the next ones make the columns orthonormal to rounding. The
product ``R`` of the triangles has the singular values and right vectors of ``X``, so its SVD (D by D)
gives the components and their variances without squaring the condition of ``X``.

Entries are fixed-point numbers: ``x = floor(scale * c) + offset``. Sums ``S`` are exact, ``n * x - S`` is
taken in whole numbers before anything is multiplied, so a large offset costs no digits.

What goes to the driver or is sent to tasks is sums by dimension and D by D matrices, whatever the number
of rows; partial Gram matrices are added by Spark, row by row of the matrix.

Defined cases: vectors that are null, or hold null or non-finite entries, take no part; vectors of
another length than the most frequent one (the longest of those, on a tie) take no part either, nor do
empty ones; entries beyond 2^52 in fixed point count as 2^52; a null vec_id is kept; a dimension that is
constant adds nothing; along a component without variance (to 1e-13 of the largest) whitened is 0 and the
identity is not asked for; identity_error is null if no component has variance; deviation is null where
it does not fit a long; repeated rows count each time; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
MOST = 1 << 52
#: Rows that one product of matrices takes.
BLOCK = 4096
ROUNDS = 12
#: A component with less of the largest variance has none.
FLAT = 1e-13


@dataclass
class Basis:
    """Fit of ``n`` vectors: exact sums by dimension, components (rows) and variances, largest first."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    rounds: int

    def projection(self) -> np.ndarray:
        """Centred rows times this are whitened; columns without variance are 0."""
        some = self.variances > FLAT * self.variances[0] if len(self.variances) and self.variances[0] > 0 else np.zeros(len(self.variances), bool)
        out = np.zeros(self.components.T.shape)
        out[:, some] = self.components[some].T / np.sqrt(self.variances[some])
        return out


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, v) of the vectors that take part, ``v`` as doubles."""
    v = F.col(column).cast("array<double>")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).alias("key"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.coalesce(whole, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (length.d if length else 0))


def _fixed(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """Fixed-point entries, a row for each vector."""
    lists = batch.column(column)
    c = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64) + OFFSET
    return x.reshape(len(lists), -1)


def _lifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` exactly, as longs where they fit, else as Python's whole numbers."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums))
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_lifted(x, n, sums) / n).astype(np.float64)


def _solved(rows: np.ndarray, triangles: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangle in turn, by forward substitution."""
    for r in triangles:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _row_sums(parts: DataFrame, d: int) -> np.ndarray:
    """Sum of partial matrices given as (i, g): row ``i`` and its entries."""
    out = np.zeros((d, d))
    for r in parts.groupBy("i").agg(*[F.sum(F.get("g", F.lit(j))).alias(f"g{j}") for j in range(d)]).collect():  # D rows
        out[r[0]] = r[1:]
    return out


def _gram(rows: DataFrame, d: int, of) -> np.ndarray:
    """Gram matrix of what ``of`` makes of each block of fixed-point rows, ``d`` columns wide."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _fixed(batch, 0)
            for at in range(0, len(x), BLOCK):
                q = of(x[at:at + BLOCK])
                total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "g"])

    return _row_sums(rows.select("v").mapInArrow(work, "i int, g array<double>"), d)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _fixed(batch, 0)
            if len(x):
                exact = x.sum(0) if len(x) * (int(np.abs(x).max()) + 1) < 1 << 62 else x.astype(object).sum(0)
                n, total = n + len(x), [int(s) + (total[j] if total else 0) for j, s in enumerate(exact)]
        if n:
            sums = pa.array([decimal.Decimal(s) for s in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), sums], ["i", "n", "s"])

    parts = rows.select("v").mapInArrow(work, "i int, n long, s decimal(38, 0)")
    got = sorted(tuple(r) for r in parts.groupBy("i").agg(F.sum("n"), F.sum("s")).collect())  # D rows
    return (got[0][1], [int(r[2]) for r in got]) if got else (0, [])


def fit(rows: DataFrame) -> Basis | None:
    """Basis of the (key, v) rows of ``usable``; None without rows."""
    n, sums = _sums(rows)
    if not n:
        return None
    d, unit, triangles, rounds = len(sums), np.finfo(np.float64).eps, [], 0
    live = None
    while True:
        def of(x: np.ndarray) -> np.ndarray:
            z = _centred(x, n, sums)
            return _solved(z if live is None else z[:, live], triangles)

        gram = _gram(rows, d if live is None else len(live), of)
        rounds += 1
        if live is None:  # constant dimensions have no part in the factors
            live = np.flatnonzero(np.diag(gram) > 0)
            gram = gram[np.ix_(live, live)]
            if not len(live):
                return Basis(n, sums, np.eye(d), np.zeros(d), 0.0, rounds)
        off = np.abs(gram - np.eye(len(live))).max()
        if triangles and (off < 1e-11 or rounds > ROUNDS):
            break
        triangles.append(_factor(gram, off, unit))
    r = np.eye(len(live))
    for t in triangles:
        r = t @ r
    _, values, right = np.linalg.svd(r)
    components = np.zeros((len(live), d))
    components[:, live] = right
    signs = np.sign(components[np.arange(len(live)), np.abs(components).argmax(1)])
    return Basis(n, sums, components * signs[:, None], values ** 2 / n, float((values ** 2).sum() / n), rounds)


def _factor(gram: np.ndarray, off: float, unit: float) -> np.ndarray:
    """Upper Cholesky factor; shifted while the columns are far from orthonormal."""
    d = len(gram)
    shift = 11 * (BLOCK * d + d * (d + 1)) * unit * np.trace(gram) if off > 0.5 else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, unit * np.trace(gram))


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, n, deviation and whitened (an array, one entry a component), with the basis' explained shares and identity_error."""
    rows = usable(vectors, key, column)
    basis = fit(rows)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if basis is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    n, sums, k = basis.n, basis.sums, min(components, len(basis.sums))
    projection = basis.projection()[:, :k]
    explained = [float(e / basis.total) if basis.total > 0 else 0.0 for e in basis.variances[:k]] + [0.0] * (k - len(basis.variances))
    projection = np.pad(projection, ((0, 0), (0, k - projection.shape[1])))
    # Whitened columns have mean 0 to rounding, since rows are centred exactly before they are projected.
    cover = _gram(rows, k, lambda x: _centred(x, n, sums) @ projection) / n
    some = np.flatnonzero(np.abs(projection).max(0) > 0)
    error = float(np.abs(cover - np.eye(k))[np.ix_(some, some)].max()) if len(some) else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _fixed(batch, 1)
            whole = _lifted(x, n, sums)
            far = int(np.abs(whole).max(initial=0))
            if whole.dtype != object and far * far * x.shape[1] < 1 << 63:
                deviation = (whole * whole).sum(1).tolist()
            else:
                deviation = [s if s < 1 << 63 else None for s in (whole.astype(object) ** 2).sum(1)]
            white = (whole / n).astype(np.float64) @ projection
            size = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n] * size, pa.int64()), pa.array(deviation, pa.int64()), pa.array(white.tolist(), pa.list_(pa.float64())),
                 pa.array([explained] * size, pa.list_(pa.float64())), pa.array([error] * size, pa.float64())],
                ["key", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(work, schema).withColumnRenamed("key", key)


def by_component(vectors: DataFrame) -> DataFrame:
    """The result of ``op12``: a row for each vector and component."""
    out = whiten(vectors)
    return out.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "n", "deviation", "identity_error").select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error")
