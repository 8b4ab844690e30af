"""Ranks, lags and running sums that stay exact and spread out when one key is hot.

A plain ``Window.partitionBy(key)`` puts a whole key in one task. Each function here first
measures the largest group (a narrow, map-side combined count). Up to ``MAX_GROUP`` rows the
plain window is used; beyond it the rows are range-sorted across tasks, so that no task holds
more than one range however large the key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonrisk.session import durable

MAX_GROUP = 2_000_000
_SHIFT, _MASK = 33, (1 << 33) - 1


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    return counts.agg(F.max("count")).first()[0] or 0


def _order_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def is_bounded(df: DataFrame, keys: Sequence[str], max_group: int | None = None) -> bool:
    """Whether every group fits one task; pass the answer on to spare repeated counts."""
    limit = MAX_GROUP if max_group is None else max_group
    return limit > 0 and largest_group(df, keys) <= limit


def _window(keys: Sequence[str], order: Sequence[str | Column]):
    base = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return base.orderBy(*_order_cols(order))




def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *,
              rn: str = "rn", total: str | None = None, bounded: bool | None = None) -> DataFrame:
    """``row_number`` within ``keys``; ``order`` must be total. Optionally the group size."""
    if (is_bounded(df, keys) if bounded is None else bounded):
        out = df.withColumn(rn, F.row_number().over(_window(keys, order)).cast("long"))
        if total:
            base = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
            out = out.withColumn(total, F.count("*").over(base))
        return out
    return _spread_ranks(df, keys, order, rn, total)


def _spread_ranks(df, keys, order, rn, total):
    marked = durable(
        df.orderBy(*[F.col(k) for k in keys], *_order_cols(order))
        .withColumn("_o_mid", F.monotonically_increasing_id())
    )
    marked = (marked.withColumn("_o_pid", F.shiftright("_o_mid", _SHIFT))
              .withColumn("_o_off", F.col("_o_mid").bitwiseAND(F.lit(_MASK))).drop("_o_mid"))
    blocks = marked.groupBy(*keys, "_o_pid").agg(F.count("*").alias("_n"), F.min("_o_off").alias("_o_first"))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = every.orderBy("_o_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        *[F.col(k).alias(f"_o_k{i}") for i, k in enumerate(keys)], F.col("_o_pid").alias("_o_bp"), "_o_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o_before"),
        F.sum("_n").over(every).alias("_o_all"),
    )
    cond = marked["_o_pid"] == starts["_o_bp"]
    for i, k in enumerate(keys):
        cond = cond & marked[k].eqNullSafe(starts[f"_o_k{i}"])
    out = marked.join(starts, cond).withColumn(
        rn, (F.col("_o_before") + F.col("_o_off") - F.col("_o_first") + 1).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_o_all"))
    return out.drop("_o_pid", "_o_off", "_o_bp", "_o_first", "_o_before", "_o_all", *[f"_o_k{i}" for i in range(len(keys))])


def with_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cols: dict[str, str], *,
             lead: bool = False, bounded: bool | None = None, block: int = 500_000) -> DataFrame:
    """Previous (or next) row's values: ``cols`` maps new name to source column."""
    if (is_bounded(df, keys) if bounded is None else bounded):
        w = _window(keys, order)
        move = F.lead if lead else F.lag
        return df.select("*", *[move(F.col(src)).over(w).alias(new) for new, src in cols.items()])
    ranked = _spread_ranks(df, keys, order, "_o_rn", None)
    # The row at each block edge is copied into the neighbouring block, then dropped again.
    blk = F.floor((F.col("_o_rn") - 1) / block)
    edge = (F.col("_o_rn") % block == 1) if lead else (F.col("_o_rn") % block == 0)
    near = blk - 1 if lead else blk + 1
    spots = F.array_compact(F.array(
        F.struct(blk.alias("b"), F.lit(True).alias("own")),
        F.when(edge | F.lit(block == 1), F.struct(near.alias("b"), F.lit(False).alias("own")))))
    halo = ranked.withColumn("_o_spot", F.explode(spots))
    w = Window.partitionBy(*keys, F.col("_o_spot.b")).orderBy("_o_rn")
    move = F.lead if lead else F.lag
    return (halo.select("*", *[move(F.col(src)).over(w).alias(new) for new, src in cols.items()])
            .where("_o_spot.own").drop("_o_spot", "_o_rn"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, str] | None = None,
            maxes: dict[str, str] | None = None, *, bounded: bool | None = None, block: int = 500_000) -> DataFrame:
    """Inclusive running sums and maxima in order: each maps new name to source column."""
    sums, maxes = sums or {}, maxes or {}
    jobs = [(new, src, F.sum) for new, src in sums.items()] + [(new, src, F.max) for new, src in maxes.items()]
    if (is_bounded(df, keys) if bounded is None else bounded):
        w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[fn(src).over(w).alias(new) for new, src, fn in jobs])
    ranked = durable(_spread_ranks(df, keys, order, "_o_rn", None)
                     .withColumn("_o_blk", F.floor((F.col("_o_rn") - 1) / block)))
    parts = ranked.groupBy(*keys, "_o_blk").agg(*[fn(src).alias(f"_o_t_{new}") for new, src, fn in jobs])
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = every.orderBy("_o_blk").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(
        *[F.col(k).alias(f"_o_k{i}") for i, k in enumerate(keys)], F.col("_o_blk").alias("_o_bb"),
        *[fn(f"_o_t_{new}").over(before).alias(f"_o_b_{new}") for new, _, fn in jobs])
    cond = ranked["_o_blk"] == base["_o_bb"]
    for i, k in enumerate(keys):
        cond = cond & ranked[k].eqNullSafe(base[f"_o_k{i}"])
    inner = (Window.partitionBy(*keys, "_o_blk").orderBy("_o_rn")
             .rowsBetween(Window.unboundedPreceding, 0))
    out = []
    for new, src, fn in jobs:
        own, base_value = fn(src).over(inner), F.col(f"_o_b_{new}")
        out.append((own + F.coalesce(base_value, F.lit(0)) if fn is F.sum else F.greatest(own, base_value)).alias(new))
    return ranked.join(base, cond).select(*df.columns, *out)


def quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, *,
             out: str = "q", weight: str | None = None, bounded: bool | None = None) -> DataFrame:
    """Exact linear-interpolated quantile per key, spread over tasks.

    Rows are reduced to distinct values with counts first; the two order statistics around
    the cut are then found from running counts.
    """
    # Read three times below, so written once.
    counts = durable(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_c")))
    run = running(counts, keys, [value], {"_to": "_c"}, bounded=bounded)
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        joined = run.join(sizes, list(keys))
    else:
        joined = run.join(F.broadcast(sizes))  # one row
    pos = (F.col("_n") - 1) * F.lit(float(q))
    lo, hi = F.floor(pos), F.ceil(pos)
    start = F.col("_to") - F.col("_c")
    hit_lo = (start <= lo) & (lo < F.col("_to"))
    hit_hi = (start <= hi) & (hi < F.col("_to"))
    picked = joined.groupBy(*keys).agg(
        F.max(F.when(hit_lo, F.col(value))).alias("_lo"), F.max(F.when(hit_hi, F.col(value))).alias("_hi"),
        F.max(pos - lo).alias("_f"))
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(out))
