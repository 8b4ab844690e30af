"""Risk models fitted with Spark ML; a fitted model scores with plain column arithmetic."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonrisk.functions.text import hash60
from phonrisk.operators import blocks, cells
from phonrisk.operators import splits as sp
from phonrisk.operators.blocks import BLOCK
from phonrisk.operators.lexicon import ROUNDS, sampled_pairs
from phonrisk.operators.ordered import is_bounded, rank_rows
from phonrisk.session import durable, stored

PERSONAL = ("x_", "ix_", "x2_")
KNOTS = 5
# Interactions the additive model may use.
INTERACTIONS = (("h_wrs", "x_r_phon"), ("c_snr_db", "x_r_phon"), ("h_audiogram_slope", "x2_min_p_onset"),
                ("h_high_freq_mean", "w2_onset_manner_fricative"), ("x_mean_evidence", "x_r_phon"), ("w_n_syllables", "x_min_p_correct"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def independence(r: str = "x_r_phon") -> Column:
    return F.least(F.greatest(F.col(r), F.lit(0.0)), F.lit(1.0))


@dataclass
class Scaling:
    """In-fold medians, means and population deviations, column by column."""

    cols: list[str]
    medians: list[float]
    means: list[float]
    sds: list[float]

    def filled(self) -> list[Column]:
        return [F.coalesce(F.col(c), F.lit(m)) for c, m in zip(self.cols, self.medians, strict=True)]

    def scaled(self) -> list[Column]:
        return [(x - F.lit(mu)) / F.lit(sd) for x, mu, sd in zip(self.filled(), self.means, self.sds, strict=True)]


def fit_scaling(train: DataFrame, cols: list[str], *, centre: bool = True, impute_zero: bool = False) -> Scaling:
    """Exact medians for columns that can be missing (per-listener clinical values, so few are
    distinct), then moments of the filled columns; columns without spread are divided by one."""
    gaps = [c for c in cols if c.startswith("h_") and not c.endswith("_missing")]
    med = {c: 0.0 for c in cols}
    if gaps and not impute_zero:
        row = train.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in gaps]).first()
        med |= {c: float(row[c]) if row[c] is not None else 0.0 for c in gaps}
    xs, medians, d = [F.col(c) for c in cols], np.array([med[c] for c in cols]), len(cols)
    fill = lambda x: np.where(np.isnan(x), medians, x)
    sums = _totals(train, xs, d + 1, lambda x: np.append(fill(x).sum(0), len(x)))
    n = max(sums[d], 1.0)
    mean = sums[:d] / n
    sds = np.sqrt(_totals(train, xs, d, lambda x: ((fill(x) - mean) ** 2).sum(0)) / n)
    return Scaling(cols, [float(m) for m in medians], [float(m) if centre else 0.0 for m in mean],
                   [float(s) if s > 1e-12 else 1.0 for s in sds])


def _vectors(df: DataFrame, xs: list[Column], *keep: str) -> DataFrame:
    names = [f"_x{i}" for i in range(len(xs))]
    wide = df.select(*keep, *[x.cast("double").alias(n) for n, x in zip(names, xs, strict=True)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).select(*keep, "features")


def require_two_classes(train: DataFrame, y: str = "misheard") -> int:
    row = train.agg(F.count("*").alias("n"), F.sum(y).alias("pos")).first()
    if not row.pos or row.pos == row.n:
        raise ValueError("training data has a single class; a probability model cannot be fitted")
    return row.n


@dataclass
class Linear:
    """A fitted linear risk: scaled columns, coefficients, optional calibration map."""

    scaling: Scaling
    coef: list[float]
    intercept: float
    name: str = "logistic"
    centre: float = 0.0
    spread: float = 1.0
    meta: dict = field(default_factory=dict)

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for x, b in zip(self.scaling.scaled(), self.coef, strict=True):
            z = z + x * F.lit(b)
        return z

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn(out, sigmoid((self.score() - self.centre) / self.spread))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Standardised coefficients, largest first."""
        rows = [(c, float(b)) for c, b in zip(self.scaling.cols, self.coef, strict=True)]
        return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.abs("coefficient").desc(), "feature")


# ---- penalised logistic regression by Newton passes


def _totals(rows: DataFrame, xs: list[Column], width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of the ``width`` numbers that ``of`` makes of a block of ``xs`` (null is NaN)."""
    n_xs = len(xs)

    def each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        x = blocks.matrix(batch.column("x"), n_xs)
        for at in range(0, len(x), BLOCK):
            yield of(x[at:at + BLOCK])

    return _summed(rows.select(blocks.numbers(xs).alias("x")), width, each)


def _summed(rows: DataFrame, width: int, each: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """Sums of all ``width`` numbers that ``each`` makes of the batches of ``rows``."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for numbers in each(batch):
                total += numbers
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(used, pa.int32()), "v": pa.array(total[used], pa.float64())})

    sums = rows.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # ``width`` numbers
    out = np.zeros(width)
    out[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return out


def _newton(rows: DataFrame, given: list[Column], xs: list[Column], design: Callable[[np.ndarray], np.ndarray], penalty: np.ndarray, *, steps: int = 50, tol: float = 1e-8) -> np.ndarray:
    """Coefficients that minimise the weighted sum of logistic losses plus sum(penalty * w^2) / 2.

    ``given`` are label, weight and offset; ``design`` makes the regressors of a block of ``xs``. A pass over
    the rows sums loss, gradient and the upper half of the Hessian.
    """
    upper = np.triu_indices(len(penalty))

    def sums_at(w: np.ndarray) -> np.ndarray:
        def of(block: np.ndarray) -> np.ndarray:
            y, weight, offset = block[:, :3].T
            z = design(block[:, 3:])
            score = offset + z @ w
            mu = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
            loss = (weight * (np.logaddexp(0, score) - y * score)).sum()
            hess = z.T @ (z * (weight * mu * (1 - mu))[:, None])
            return np.concatenate([[loss], z.T @ (weight * (mu - y)), hess[upper]])

        return _totals(rows, [*given, *xs], 1 + len(penalty) + len(upper[0]), of)

    return _minimise(sums_at, penalty, steps, tol)


def _minimise(sums_at: Callable[[np.ndarray], np.ndarray], penalty: np.ndarray, steps: int = 50, tol: float = 1e-8) -> np.ndarray:
    """Newton steps on a loss whose sums (loss, gradient, upper half of the Hessian) are given at any coefficients; a step is halved while it raises the loss."""
    d = len(penalty)
    upper = np.triu_indices(d)
    w, last = np.zeros(d), (np.inf, np.zeros(d))
    for _ in range(steps):
        sums = sums_at(w)
        loss = sums[0] + (penalty * w * w).sum() / 2
        if loss > last[0] + 1e-9 * abs(loss):
            w = (w + last[1]) / 2
            continue
        last = (loss, w)
        hess = np.zeros((d, d))
        hess[upper] = sums[1 + d:]
        hess = hess + np.triu(hess, 1).T + np.diag(penalty)
        move = np.linalg.lstsq(hess, sums[1:1 + d] + penalty * w, rcond=None)[0]
        w = w - move
        if np.abs(move).max() < tol:
            break
    return w


def _standardised(scaling: Scaling, *, intercept: bool = True) -> Callable[[np.ndarray], np.ndarray]:
    medians, means, sds = (np.array(v) for v in (scaling.medians, scaling.means, scaling.sds))

    def design(x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), medians, x) - means) / sds
        return np.column_stack([np.ones(len(z)), z]) if intercept else z

    return design


def _fit_linear(rows: DataFrame, scaling: Scaling, y: Column, weight: Column, offset: Column, l2: float, *, free: float = 0.0, intercept: bool = True, **options) -> tuple[list[float], float]:
    penalty = np.array([free] * intercept + [l2] * len(scaling.cols))
    w = _newton(rows, [y, weight, offset], [F.col(c) for c in scaling.cols], _standardised(scaling, intercept=intercept), penalty, **options)
    return [float(v) for v in w[intercept:]], float(w[0]) if intercept else 0.0


def fit_logistic(train: DataFrame, cols: list[str], *, y: str = "misheard", C: float = 1.0, weight: str | None = None) -> Linear:
    """L2 logistic regression: sum loss + |w|^2 / 2C, the intercept free. ``train`` is read once a Newton step."""
    require_two_classes(train, y)
    scaling = fit_scaling(train, cols)
    share = train.agg(F.avg(weight)).first()[0] if weight else 1.0
    coef, intercept = _fit_linear(train, scaling, F.col(y), F.col(weight) if weight else F.lit(1.0), F.lit(0.0), share / C)
    return Linear(scaling, coef, intercept)


# ---- base + personal residual with a true offset


@dataclass
class Residual:
    base: Linear
    personal: Linear

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        based = self.base.predict(df, "_b")
        return based.withColumn(out, sigmoid(logit(F.col("_b")) + self.personal.score())).drop("_b")

    def strength(self) -> float:
        return float(np.linalg.norm(self.personal.coef))


def fit_offset_logistic(df: DataFrame, cols: list[str], offset: Column, *, y: str = "misheard", l2: float = 1.0, steps: int = 50) -> Linear:
    """Penalised logistic regression on top of a fixed per-row offset, by Newton steps."""
    scaling = fit_scaling(df, cols)
    coef, intercept = _fit_linear(df, scaling, F.col(y), F.lit(1.0), offset, l2, free=1e-9, steps=steps)
    return Linear(scaling, coef, intercept, name="offset")


def split_columns(cols: list[str]) -> tuple[list[str], list[str]]:
    personal = [c for c in cols if c.startswith(PERSONAL)]
    return [c for c in cols if c not in set(personal)], personal


def fit_residual(train: DataFrame, cols: list[str], *, l2: float = 1.0, y: str = "misheard") -> Residual:
    base_cols, personal = split_columns(cols)
    if not personal:
        raise ValueError("the residual model needs personal confusion columns")
    base = fit_logistic(train, base_cols, y=y)
    with_base = base.predict(train, "_b")
    return Residual(base, fit_offset_logistic(with_base, personal, logit(F.col("_b")), y=y, l2=l2))


def fit_cross_fitted(train: DataFrame, cols: list[str], *, folds: int = 3, l2: float = 1.0, y: str = "misheard", seed: int = 0) -> Residual:
    """Residual whose offset comes from inner listener folds; the base is refitted on everything."""
    base_cols, personal = split_columns(cols)
    inner = stored(train.join(sp.listener_folds(train, folds, y=y, seed=seed), "listener_id"), "inner")  # each fit reads it once a step
    parts = None
    for k in range(folds):
        m = fit_logistic(inner.where(F.col("fold") != k), base_cols, y=y)
        held = m.predict(inner.where(F.col("fold") == k), "_b")
        parts = held if parts is None else parts.unionByName(held)
    residual = fit_offset_logistic(stored(parts, "held"), personal, logit(F.col("_b")), y=y, l2=l2)
    return Residual(fit_logistic(train, base_cols, y=y), residual)


# ---- additive splines


def _cubic(u: Column) -> Column:
    """The cardinal cubic B-spline on [0, 4)."""
    return (F.when((u < 0) | (u >= 4), 0.0).when(u < 1, u * u * u / 6)
            .when(u < 2, (-3 * u * u * u + 12 * u * u - 12 * u + 4) / 6)
            .when(u < 3, (3 * u * u * u - 24 * u * u + 60 * u - 44) / 6).otherwise((4 - u) * (4 - u) * (4 - u) / 6))


def spline_basis(xs: list[Column], ranges: list[tuple[float, float]], knots: int = KNOTS) -> Column:
    """ARRAY<DOUBLE> of uniform cubic B-splines of every x on its range, constant outside, the
    last basis function of each left out."""
    each = F.array(*[F.struct(((F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - F.lit(lo)) / F.lit(h)).alias("u"))
                     for x, (lo, hi), h in zip(xs, ranges, _steps(ranges, knots), strict=True)])
    places = F.sequence(F.lit(0), F.lit(knots))
    return F.flatten(F.transform(each, lambda s: F.transform(places, lambda j: _cubic(s["u"] - j + 3))))


def _steps(ranges: list[tuple[float, float]], knots: int = KNOTS) -> list[float]:
    return [(hi - lo) / (knots - 1) if hi > lo else 1.0 for lo, hi in ranges]


def _basis_of(x: np.ndarray, ranges: list[tuple[float, float]], knots: int = KNOTS) -> np.ndarray:
    """``spline_basis`` of a block of rows: four functions of a column are not zero, from the interval of the value on."""
    lo, hi = np.array(ranges).T
    u = (np.clip(x, lo, hi) - lo) / np.array(_steps(ranges, knots))
    k = np.floor(u).astype(int)
    f, g = u - k, 1 - (u - k)
    out = np.zeros((*x.shape, knots + 3))
    row, col = np.ogrid[:x.shape[0], :x.shape[1]]
    for i, v in enumerate((g * g * g / 6, (3 * f * f * f - 6 * f * f + 4) / 6, (3 * g * g * g - 6 * g * g + 4) / 6, f * f * f / 6)):
        out[row, col, k + i] = v
    return out[:, :, :knots + 1].reshape(len(x), -1)


@dataclass
class Additive:
    """Splines of columns and products; ``coef`` is per basis function, ``intercept`` takes their means in."""

    medians: dict[str, float]
    ranges: dict[str, tuple[float, float]]
    pairs: list[tuple[str, str]]
    coef: list[float]
    intercept: float

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        ranges, coef, intercept = list(self.ranges.values()), np.array(self.coef), self.intercept

        def work(x: pa.Array) -> pa.Array:
            values = blocks.matrix(x, len(ranges))
            z = [_basis_of(values[at:at + BLOCK], ranges) @ coef for at in range(0, len(x), BLOCK)]
            score = np.concatenate(z) + intercept if z else np.zeros(0)
            return pa.array(1 / (1 + np.exp(-np.clip(score, -700, 700))))

        xs = _augmented([c for c in self.ranges if "*" not in c], self.pairs, self.medians)
        return df.withColumn(out, F.arrow_udf(work, "double")(blocks.numbers(xs.values())))


def _augmented(cols: list[str], pairs: list[tuple[str, str]], med: dict[str, float]) -> dict[str, Column]:
    out = {c: F.coalesce(F.col(c), F.lit(med[c])) for c in cols}
    for a, b in pairs:
        out[f"{a}*{b}"] = F.coalesce(F.col(a) * F.col(b), F.lit(med[f"{a}*{b}"]))
    return out


def fit_additive(train: DataFrame, cols: list[str], *, y: str = "misheard", C: float = 0.5) -> Additive:
    """Per-column splines plus the listed interactions, then L2 logistic regression.

    Basis values are made of each block of rows as it is read and never stored.
    """
    n = require_two_classes(train, y)
    pairs = [(a, b) for a, b in INTERACTIONS if a in cols and b in cols]
    gaps = [c for c in cols if c.startswith("h_") and not c.endswith("_missing")]
    gappy = {c: F.col(c) for c in gaps} | {f"{a}*{b}": F.col(a) * F.col(b) for a, b in pairs if a in gaps or b in gaps}
    med = {c: 0.0 for c in [*cols, *[f"{a}*{b}" for a, b in pairs]]}
    if gappy:
        # Products are continuous, so their medians are approximate (rank error 1/10,000).
        names = list(gappy)
        row = train.agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"q{i}") for i, x in enumerate(gappy.values())]).first()
        med |= {c: float(row[f"q{i}"] or 0.0) for i, c in enumerate(names)}
    aug = _augmented(cols, pairs, med)
    lim = train.agg(*[F.min(x).alias(f"lo{i}") for i, x in enumerate(aug.values())], *[F.max(x).alias(f"hi{i}") for i, x in enumerate(aug.values())]).first()
    ranges = {c: (float(lim[f"lo{i}"]), float(lim[f"hi{i}"])) for i, c in enumerate(aug)}
    xs, bounds = list(aug.values()), list(ranges.values())
    width = len(xs) * (KNOTS + 1)
    mean = _totals(train, xs, width, lambda x: _basis_of(x, bounds).sum(0)) / n
    spread = np.sqrt(_totals(train, xs, width, lambda x: ((_basis_of(x, bounds) - mean) ** 2).sum(0)) / max(n - 1, 1))
    scale = np.where(spread > 1e-9, 1 / np.where(spread > 1e-9, spread, 1.0), 0.0)  # a basis function without spread has no part

    def design(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (_basis_of(x, bounds) - mean) * scale])

    w = _newton(train, [F.col(y), F.lit(1.0), F.lit(0.0)], xs, design, np.array([0.0] + [1 / C] * width))
    coef = w[1:] * scale
    return Additive(med, ranges, pairs, [float(v) for v in coef], float(w[0] - mean @ coef))


# ---- rankers inside a listener


def _deltas(train: DataFrame, cols: list[str], cap: int, y: str, seed: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """The drawn pairs' differences as rows: what a ranker is fitted to, which the fit itself never writes out."""
    pairs = sampled_pairs(train, cap, y=y, keep=(*cols, *extra), seed=seed)
    diff = [(F.coalesce(F.col(f"pos_{c}"), F.lit(0.0)) - F.coalesce(F.col(f"neg_{c}"), F.lit(0.0))).alias(c) for c in cols]
    return pairs.select(*diff, *[F.col(f"{s}_{e}") for e in extra for s in ("pos", "neg")])


def _placed(train: DataFrame, cols: list[str], y: str, seed: int, score: str | None, listener: str = "listener_id", row: str = "row_id") -> DataFrame:
    """Rows with what drawing needs: their place ``_k`` on their side of the listener, the sides' sizes ``_m`` and ``_n``, and with ``score`` their ``_rank``.

    Listeners' rows come together, after one shuffle of the matrix; a listener too large for a window is ranked over tasks before.
    """
    xs = blocks.numbers([F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    order = [] if score is None else [F.col("_score").desc(), row]
    df = train.select(listener, y, row, xs.alias("x"), *([] if score is None else [F.col(score).alias("_score")]), hash60(F.concat_ws(":", F.lit(f"side{seed}"), F.col(row))).alias("_h"))
    m, n = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    if is_bounded(train, [listener]):
        whole = Window.partitionBy(listener)
        df = df.repartition(listener)
        if order:
            df = df.withColumn("_rank", F.row_number().over(whole.orderBy(*order)).cast("long"))
        df = df.withColumns({"_m": m.over(whole), "_n": n.over(whole)})
        df = df.withColumn("_k", F.row_number().over(Window.partitionBy(listener, y).orderBy("_h", row)).cast("long"))
    else:
        sizes = df.groupBy(listener).agg(m.alias("_m"), n.alias("_n"))
        if order:
            df = rank_rows(df, [listener], order, rn="_rank", bounded=False)
        df = rank_rows(df, [listener, y], ["_h", row], rn="_k", bounded=False).join(sizes, listener)
        df = df.repartition(listener).sortWithinPartitions(listener)
    rank = F.col("_rank") if order else F.lit(None).cast("long")
    return df.select(F.col(listener).cast("string").alias("_name"), F.col(y).cast("int").alias("_y"), "_k", "_m", "_n", rank.alias("_rank"), "x")


def _drawn(name: str, m: int, n: int, cap: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 1) on the two sides of a listener's pairs: those of ``lexicon.sampled_pairs``, with one hash for each place a shift depends on."""
    i = np.arange(min(m * n, cap))
    a, b = i // n, i % n
    for r in range(ROUNDS):
        moved, other, size, places = (a, b, m, n) if r % 2 == 0 else (b, a, n, m)
        asked, at = (np.arange(places), other) if places <= len(i) else np.unique(other, return_inverse=True)
        key = f"pair{seed}:{name}:{r}:".encode()
        shift = [(int.from_bytes(md5(key + b"%d" % o).digest()[:8]) >> 4) % size for o in asked.tolist()]  # ``hash60``
        moved = (moved + np.array(shift)[at]) % size
        a, b = (moved, b) if r % 2 == 0 else (a, moved)
    return a + 1, b + 1


#: A listener's rows that may stand in pairs, column by column and without the columns that are the same in all of them (``cols`` are the others), the
#: pairs as places of a misheard and a heard row, and their weights: as bytes, since Parquet takes an array's numbers one by one.
PAIRED = "cols binary, x binary, a binary, b binary, v binary"


def _paired(placed: DataFrame, n_cols: int, cap: int, seed: int) -> DataFrame:
    """One ``PAIRED`` row for each listener with both kinds of words. Pairs are never rows: at most 2 ``cap`` rows of a listener are held."""
    def close(name: str, pieces: list[tuple], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        y, k, rank, x = (np.concatenate(c) for c in zip(*pieces, strict=True))
        places = [np.flatnonzero(y == side) for side in (1, 0)]
        ends = []
        for mine, at in zip(places, (a, b), strict=True):
            order = mine[np.argsort(k[mine])]
            ends.append(order[np.searchsorted(k[order], at)])
        weights = np.ones(len(a)) if np.isnan(rank).any() else np.abs(1 / np.log2(rank[ends[0]] + 1) - 1 / np.log2(rank[ends[1]] + 1))
        varied = np.flatnonzero((x != x[0]).any(axis=0)).astype(np.int32)
        return varied, np.ascontiguousarray(x.T[varied]), *(e.astype(np.int32) for e in ends), weights

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in values], pa.binary()) for values in zip(*rows, strict=True)], ["cols", "x", "a", "b", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, pieces, a, b, out = None, [], None, None, []
        for batch in batches:
            names = batch.column("_name").to_numpy(zero_copy_only=False)
            y, k, m, n = (batch.column(c).to_numpy() for c in ("_y", "_k", "_m", "_n"))
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(float)
            x = blocks.matrix(batch.column("x"), n_cols)
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, int)
            for lo, hi in zip(starts, np.append(starts[1:], len(names)), strict=True):
                if names[lo] != name:
                    if pieces:
                        out.append(close(name, pieces, a, b))
                        if len(out) == 50:
                            yield batch_of(out)
                            out = []
                    name, pieces = names[lo], []
                    a, b = _drawn(name, int(m[lo]), int(n[lo]), cap, seed) if m[lo] and n[lo] else (None, None)
                if a is not None:
                    used = slice(None) if max(m[lo], n[lo]) <= cap else np.where(y[lo:hi] == 1, np.isin(k[lo:hi], a), np.isin(k[lo:hi], b) & (y[lo:hi] == 0))
                    pieces.append((y[lo:hi][used], k[lo:hi][used], rank[lo:hi][used], x[lo:hi][used]))
        if pieces:
            out.append(close(name, pieces, a, b))
        if out:
            yield batch_of(out)

    return placed.mapInArrow(work, PAIRED)


def _each_paired(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(cols, columns x rows, a, b, v) of each listener."""
    kinds = {"cols": np.int32, "x": float, "a": np.int32, "b": np.int32, "v": float}
    for row in zip(*(batch.column(c) for c in kinds), strict=True):
        cols, x, *pairs = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(row, kinds.values(), strict=True))
        yield cols, x.reshape(len(cols), -1) if len(cols) else np.zeros((0, 1 + max(p.max() for p in pairs[:2]))), *pairs


def _fit_pairs(placed: DataFrame, cols: list[str], cap: int, seed: int, C: float) -> Linear:
    """A pair's loss reads the scores of its two rows, so sums over pairs are sums over a listener's rows: X c and X L X'."""
    d = len(cols)
    pairs = stored(_paired(placed, d, cap, seed), "pairs")
    upper = np.triu_indices(d)

    def sizes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        total = np.zeros(2 + d)
        for at, x, a, b, v in _each_paired(batch):
            diff = x[:, a] - x[:, b]
            total[:2] += len(a), v.sum()
            total[2 + at] += (diff * diff).sum(axis=1)
        yield total

    size = _summed(pairs, 2 + d, sizes)
    n = int(size[0])
    if n == 0:
        raise ValueError("no listener has both misheard and heard words; a ranker cannot be fitted")
    sds = [s if s > 1e-12 else 1.0 for s in np.sqrt(size[2:] / n).tolist()]

    def sums_at(w: np.ndarray) -> np.ndarray:
        def each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            loss, gradient, hess = 0.0, np.zeros(d), np.zeros((d, d))
            for at, x, a, b, v in _each_paired(batch):
                x, r = x / np.array(sds)[at, None], x.shape[1]
                score = w[at] @ x
                gap = score[a] - score[b]
                mu = 1 / (1 + np.exp(-np.clip(gap, -700, 700)))
                pull, bend = 2 * v * (mu - 1), 2 * v * mu * (1 - mu)  # a pair and its mirror image have the same loss: each is read once, with twice its weight
                loss += (2 * v * np.logaddexp(0, -gap)).sum()
                gradient[at] += x @ (np.bincount(a, pull, r) - np.bincount(b, pull, r))
                if r * (r + d) < d * len(a):
                    links = np.bincount(a * r + b, bend, r * r).reshape(r, r)
                    lap = np.diag(links.sum(0) + links.sum(1)) - links - links.T
                    hess[np.ix_(at, at)] += (x @ lap) @ x.T
                else:
                    z = x[:, a] - x[:, b]
                    hess[np.ix_(at, at)] += (z * bend) @ z.T
            yield np.concatenate([[loss], gradient, hess[upper]])

        return _summed(pairs, 1 + d + len(upper[0]), each)

    w = _minimise(sums_at, np.full(d, size[1] / n / C))
    # Differences and their mirror images add up to means of zero.
    scaling = Scaling(cols, [0.0] * d, [0.0] * d, sds)
    return Linear(scaling, [float(v) for v in w], 0.0, name="pairwise", meta={"n_pairs": n, "output_is_probability": False})


def _squash(model: Linear, train: DataFrame) -> Linear:
    """Centre and scale of the training scores, so that the sigmoid keeps the order unsaturated."""
    medians, of = np.array(model.scaling.medians), np.array(model.coef) / np.array(model.scaling.sds)

    def moments(x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), medians, x) - np.array(model.scaling.means)) @ of + model.intercept
        return np.array([len(z), z.sum(), (z * z).sum()])

    n, total, square = _totals(train, [F.col(c) for c in model.scaling.cols], 3, moments)
    sd = float(np.sqrt(max(square / n - (total / n) ** 2, 0.0)))
    model.centre, model.spread = float(total / n), sd if sd > 1e-12 else 1.0
    return model


def fit_pairwise_ranker(train: DataFrame, cols: list[str], *, cap: int = 400, C: float = 1.0, y: str = "misheard", seed: int = 0) -> Linear:
    """Linear ranker on differences of (misheard, heard) words of one listener."""
    require_two_classes(train, y)
    return _squash(_fit_pairs(_placed(train, cols, y, seed, None), cols, cap, seed, C), train)


def fit_listwise_ranker(train: DataFrame, cols: list[str], *, cap: int = 400, C: float = 1.0, y: str = "misheard", seed: int = 0) -> Linear:
    """Pairs weighted by how much swapping them would change the listener's nDCG under a first model."""
    first = fit_logistic(train, cols, y=y)
    return _squash(_fit_pairs(_placed(first.predict(train, "_p"), cols, y, seed, "_p"), cols, cap, seed, C), train)


# ---- trees


@dataclass
class Trees:
    scaling: Scaling
    model: object

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        keep = df.columns
        scored = self.model.transform(_vectors(df, self.scaling.filled(), *keep))
        return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def fit_boosted(train: DataFrame, cols: list[str], *, y: str = "misheard", max_iter: int = 200, seed: int = 0) -> Trees:
    """Boosted trees comparator (imputed: Spark's trees have no missing-value branch)."""
    require_two_classes(train, y)
    scaling = fit_scaling(train, cols)
    data = durable(_vectors(train, scaling.filled(), y))
    gbt = GBTClassifier(labelCol=y, maxIter=max_iter, stepSize=0.06, maxDepth=4, minInstancesPerNode=40, seed=seed, cacheNodeIds=True)
    return Trees(scaling, gbt.fit(data))


# ---- calibration on held-out listeners


@dataclass
class Calibrated:
    base: object
    method: str
    effective: str
    reason: str | None = None
    platt: tuple[float, float] | None = None
    steps: object = None

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        raw = self.base.predict(df, out)
        if self.platt:
            a, b = self.platt
            return raw.withColumn(out, sigmoid(F.lit(a) * logit(F.col(out)) + F.lit(b)))
        if self.steps is not None:
            keep = raw.columns
            got = self.steps.transform(raw.withColumnRenamed(out, "_raw"))
            return got.withColumn(out, F.least(F.greatest(F.col("_cal"), F.lit(0.0)), F.lit(1.0))).select(*keep)
        return raw


def fit_calibrated(train: DataFrame, cols: list[str], fit: Callable, *, method: str = "platt", fraction: float = 0.25, seed: int = 0, y: str = "misheard") -> Calibrated:
    """Calibrate on listeners the base model did not see; one-class slices fall back, with the reason."""
    if method == "none":
        return Calibrated(fit(train, cols), "none", "none")
    held = stored(train.join(sp.calibration_holdout(train, fraction, seed=seed), "listener_id"), "holdout")
    base = fit(held.where("not held_out"), cols)
    slice_ = durable(base.predict(held.where("held_out"), "_raw").select("_raw", y))
    seen = slice_.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    if seen.lo == seen.hi:
        return Calibrated(fit(train, cols), method, "none", "calibration slice has one class")
    if method == "platt":
        one = Scaling(["_z"], [0.0], [0.0], [1.0])
        coef, intercept = _fit_linear(slice_.select(y, logit(F.col("_raw")).alias("_z")), one, F.col(y), F.lit(1.0), F.lit(0.0), 1.0)
        return Calibrated(base, method, method, platt=(coef[0], intercept))
    iso = IsotonicRegression(featuresCol="_raw", labelCol=y, predictionCol="_cal").fit(slice_.withColumn(y, F.col(y).cast("double")))
    return Calibrated(base, method, method, steps=iso)


MODELS: dict[str, Callable] = {
    "logistic": fit_logistic, "residual": fit_residual, "cross_fitted_residual": fit_cross_fitted, "spline_gam": fit_additive,
    "listener_ranking": fit_listwise_ranker, "pairwise_logistic": fit_pairwise_ranker, "gradient_boosting": fit_boosted,
}


def out_of_fold(matrix: DataFrame, cols: list[str], fit: Callable, *, k: int = 5, seed: int = 0, calibration: str = "none") -> tuple[DataFrame, list[dict]]:
    """(row_id, listener_id, misheard, fold, p) with every row predicted by a model that never saw
    its listener, and the calibration log per fold. k fits over one stored table of the matrix with its folds;
    plain logistic fits share their passes."""
    folds = durable(sp.listener_folds(matrix, k, seed=seed))
    sp.assert_no_leak(sp.leaked_listeners(folds))
    data = stored(matrix.join(folds, "listener_id"), "folded")  # each fit reads it once a step
    if fit is fit_logistic and calibration == "none":
        one = data.withColumn("seed", F.lit(0).cast("long"))  # all folds in the same passes
        held = cells.predict_held_out(one, cols, cells.fit_logistic_cells(one, cols), ["row_id", "listener_id", "misheard", "fold"])
        return durable(held), [{"fold": f, "requested_method": "none", "effective_method": "none", "fallback_reason": None} for f in range(k)]
    parts, log = None, []
    for f in range(k):
        m = fit_calibrated(data.where(F.col("fold") != f), cols, fit, method=calibration, seed=seed)
        log.append({"fold": f, "requested_method": m.method, "effective_method": m.effective, "fallback_reason": m.reason})
        held = m.predict(data.where(F.col("fold") == f), "p").select("row_id", "listener_id", "misheard", "fold", "p")
        parts = held if parts is None else parts.unionByName(held)
    return durable(parts), log


def canonical_order(df: DataFrame, listener: str = "listener_id") -> list[Column]:
    """Order by content, so that ranked sampling does not depend on input order."""
    return [F.col(listener), F.md5(F.to_json(F.struct(*sorted(df.columns))))]


def save_linear(model: Linear, spark: SparkSession, path: str, **meta) -> None:
    """One JSON row: parameters plus contract metadata."""
    body = {"scaling": asdict(model.scaling), "coef": model.coef, "intercept": model.intercept, "name": model.name,
            "centre": model.centre, "spread": model.spread, "meta": meta}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_linear(spark: SparkSession, path: str, *, schema_hash: str | None = None) -> Linear:
    body = json.loads(spark.read.text(path).first().value)
    if schema_hash is not None and body["meta"].get("schema_hash") != schema_hash:
        raise ValueError("feature schema differs from the one the model was fitted on")
    return Linear(Scaling(**body["scaling"]), body["coef"], body["intercept"], body["name"], body["centre"], body["spread"], body["meta"])
