"""Logistic regressions of many study cells, fitted side by side.

A cell is one (seed, fold): it trains on all rows of its seed outside its fold. Every pass over the
matrix adds up loss, gradient and Hessian of all cells at once, so a study of any number of seeds and
folds takes as many passes as its slowest fit takes Newton steps, instead of that many jobs a cell.
What comes back to the driver is (d + 1)^2 numbers a cell, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonrisk.operators import blocks

KEYS = ["seed", "fold"]


@dataclass
class CellFit:
    """Scaling and weights (intercept first) of one cell."""

    medians: np.ndarray
    means: np.ndarray
    sds: np.ndarray
    w: np.ndarray
    n_train: int
    steps: int

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), self.medians, x) - self.means) / self.sds
        return np.column_stack([np.ones(len(z)), z])


def training_medians(rows: DataFrame, cols: list[str]) -> dict[tuple[int, int], np.ndarray]:
    """Median of each column over each cell's training rows; 0 where nothing is known.

    Only columns that can be missing are looked at; they hold a listener's measures, so their
    distinct values with counts are few.
    """
    gaps = [c for c in cols if c.startswith("h_") and not c.endswith("_missing")]
    folds = [tuple(r) for r in rows.select(*KEYS).distinct().collect()]  # the study's cells
    out = {cell: np.zeros(len(cols)) for cell in folds}
    if not gaps:
        return out
    each = F.array(*[F.struct(F.lit(cols.index(c)).alias("c"), F.col(c).cast("double").alias("v")) for c in gaps])
    values = rows.select(*KEYS, F.inline(each)).where("v is not null").groupBy(*KEYS, "c", "v").agg(F.count("*").alias("n"))
    held = rows.sparkSession.createDataFrame(folds, "seed long, cell long")
    trained = values.join(F.broadcast(held), "seed").where("cell <> fold")  # one row a cell of the study
    for r in trained.groupBy("seed", "cell", "c").agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("m")).collect():
        out[r.seed, r.cell][r.c] = r.m
    return out


def _passes(rows: DataFrame, cols: list[str], y: str, cells: list[tuple[int, int]], width: int, of) -> dict[tuple[int, int], np.ndarray]:
    """Sums over each cell's training rows of the ``width`` numbers that ``of(cell, x, y)`` makes of a block."""
    by_seed: dict[int, list[tuple[int, int]]] = {}
    for seed, fold in cells:
        by_seed.setdefault(seed, []).append((seed, fold))
    place = {cell: i for i, cell in enumerate(cells)}
    n_cols = len(cols) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cells), width))
        for batch in batches:
            for (seed, fold), part in _by_cell(batch, n_cols):
                for at in range(0, len(part), blocks.BLOCK):
                    x, t = part[at:at + blocks.BLOCK, 1:], part[at:at + blocks.BLOCK, 0]
                    for cell in by_seed.get(seed, ()):
                        if cell[1] != fold:
                            total[place[cell]] += of(cell, x, t)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int64()), "v": pa.array(total.ravel()[used], pa.float64())})

    sums = _numbers(rows, [y, *cols]).mapInArrow(work, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # cells x width
    out = np.zeros(len(cells) * width)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return dict(zip(cells, out.reshape(len(cells), width), strict=True))


def _numbers(rows: DataFrame, cols: list[str], *keep: str) -> DataFrame:
    return rows.select(*[F.col(k).cast("long") for k in KEYS], *[F.col(c).alias(f"_{c}") for c in keep], blocks.numbers(cols).alias("x"))


def _by_cell(batch: pa.RecordBatch, width: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """The rows of a batch's ``x`` of each (seed, fold) in it."""
    x = blocks.matrix(batch.column("x"), width)
    for cell, at in _places(batch):
        yield cell, x if len(at) == len(x) else x[at]


def _places(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Where the rows of each (seed, fold) of a batch stand."""
    seed, fold = (batch.column(k).to_numpy() for k in KEYS)
    order = np.lexsort((fold, seed))
    starts = np.flatnonzero(np.diff(seed[order], prepend=seed[order][:1] - 1).astype(bool) | np.diff(fold[order], prepend=fold[order][:1]).astype(bool))
    for at in np.split(order, starts[1:]) if len(order) else ():
        yield (int(seed[at[0]]), int(fold[at[0]])), at


def fit_logistic_cells(rows: DataFrame, cols: list[str], *, y: str = "misheard", C: float = 1.0, steps: int = 50, tol: float = 1e-8) -> dict[tuple[int, int], CellFit]:
    """L2 logistic regression (sum of losses + |w|^2 / 2C, intercept free) of every (seed, fold) in ``rows``.

    Newton's steps are halved while they do not lower the loss. A cell whose training rows are of one
    class is an error, as for a single fit.
    """
    d = len(cols) + 1
    upper = np.triu_indices(d)
    medians = training_medians(rows, cols)
    cells = sorted(medians)

    def moments(cell, x, t):
        x = np.where(np.isnan(x), medians[cell], x)
        return np.concatenate([[len(t), t.sum()], x.sum(0), (x * x).sum(0)])

    fits: dict[tuple[int, int], CellFit] = {}
    for cell, s in _passes(rows, cols, y, cells, 2 + 2 * (d - 1), moments).items():
        n = s[0]
        if not n or s[1] in (0, n):
            raise ValueError(f"training data of cell {cell} has a single class; a probability model cannot be fitted")
        mean = s[2:1 + d] / n
        sd = np.sqrt(np.maximum(s[1 + d:] / n - mean ** 2, 0))
        fits[cell] = CellFit(medians[cell], mean, np.where(sd > 1e-6 * (1e-6 + np.abs(mean)), sd, 1.0), np.zeros(d), int(n), 0)

    ridge = np.diag([0.0] + [1 / C] * (d - 1))
    last = {c: (np.inf, fits[c].w) for c in cells}
    open_cells = list(cells)
    for _ in range(steps):
        def parts(cell, x, t):
            f = fits[cell]
            z = f.features(x)
            score = z @ f.w
            mu = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
            return np.concatenate([[np.logaddexp(0, score).sum() - (t * score).sum()], z.T @ (mu - t), (z.T @ (z * (mu * (1 - mu))[:, None]))[upper]])

        left = []
        for cell, s in _passes(rows, cols, y, open_cells, 1 + d + len(upper[0]), parts).items():
            f = fits[cell]
            f.steps += 1
            loss = s[0] + f.w @ ridge @ f.w / 2
            if loss > last[cell][0] + 1e-9 * abs(loss):
                f.w = (f.w + last[cell][1]) / 2
                left.append(cell)
                continue
            last[cell] = (loss, f.w)
            hess = np.zeros((d, d))
            hess[upper] = s[1 + d:]
            move = np.linalg.lstsq(hess + np.triu(hess, 1).T + ridge, s[1:1 + d] + ridge @ f.w, rcond=None)[0]
            f.w = f.w - move
            if np.abs(move).max() > tol:
                left.append(cell)
        open_cells = left
        if not open_cells:
            break
    return fits


def predict_held_out(rows: DataFrame, cols: list[str], fits: dict[tuple[int, int], CellFit], keep: list[str], out: str = "p") -> DataFrame:
    """``keep`` and the probability of each row under its own cell's fit, which never saw its listener."""
    n_cols, kept = len(cols), [*keep, out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, p = blocks.matrix(batch.column("x"), n_cols), np.empty(batch.num_rows)
            for cell, at in _places(batch):
                f = fits[cell]
                p[at] = 1 / (1 + np.exp(-np.clip((f.features(x[at]) * f.w).sum(1), -700, 700)))  # row by row: equal rows have equal scores
            yield pa.RecordBatch.from_arrays([*[batch.column(f"_{c}") for c in keep], pa.array(p)], kept)

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + f", {out} double"
    return _numbers(rows, cols, *keep).mapInArrow(work, schema)
