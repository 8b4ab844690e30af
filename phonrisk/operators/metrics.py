"""Classification, ranking and calibration metrics by arbitrary keys.

Everything comes from one small table: positives and rows per (keys, distinct score), which is
combined before its shuffle. Rank metrics need one running sum over distinct scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonrisk.functions.text import uniform
from phonrisk.operators.ordered import rank_rows, running
from phonrisk.session import durable, stored

ECE_BINS = 10


def bad_inputs(df: DataFrame, y: str = "misheard", p: str = "score") -> DataFrame:
    """Counts of label and score rule breaks; any above zero, or no rows, is an error."""
    prob = F.col(p)
    return df.agg(F.count("*").alias("n_rows"),
                  F.count_if(F.coalesce(~F.col(y).isin(0, 1), F.lit(True))).alias("n_bad_label"),
                  F.count_if(prob.isNull() | F.isnan(prob)).alias("n_not_finite"),
                  F.count_if(F.coalesce(~prob.between(0, 1), F.lit(False))).alias("n_out_of_range"))


def validate(df: DataFrame, y: str = "misheard", p: str = "score") -> None:
    row = bad_inputs(df, y, p).first()
    if row.n_rows == 0:
        raise ValueError("cannot compute metrics on an empty sample")
    if row.n_bad_label or row.n_not_finite or row.n_out_of_range:
        raise ValueError(f"bad metric input: {row.asDict()}")


def score_counts(df: DataFrame, keys: list[str], y: str = "misheard", p: str = "score", weight: str | None = None) -> DataFrame:
    """Rows ``n`` and positives ``pos`` per (keys, score)."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*keys, F.col(p).alias("p")).agg(F.sum(w).alias("n"), F.sum(w * F.col(y)).alias("pos"))


def threshold_metrics(counts: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    hit = F.col("p") >= threshold
    tp, fp = F.sum(F.when(hit, F.col("pos")).otherwise(0)), F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0))
    base = counts.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), F.sum("n").alias("n"), F.sum("pos").alias("n_pos"))
    base = base.withColumn("fn", F.col("n_pos") - F.col("tp")).withColumn("tn", F.col("n") - F.col("n_pos") - F.col("fp"))
    d = lambda c: F.col(c).cast("double")
    return base.select(
        *keys, "n", "n_pos", "tp", "fp", "tn", "fn", F.try_divide(d("tp"), F.col("n_pos")).alias("recall"),
        F.try_divide(d("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(d("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
        F.when(F.col("tp") > 0, F.try_divide(2 * d("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        ((d("tp") + F.col("tn")) / F.col("n")).alias("accuracy"))


def probability_metrics(counts: DataFrame, keys: list[str], clip: float = 1e-15) -> DataFrame:
    """Brier score, log loss and prevalence."""
    p, pos, neg = F.col("p"), F.col("pos"), F.col("n") - F.col("pos")
    pc = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    n = F.sum("n")
    return counts.groupBy(*keys).agg(
        (F.sum(pos * F.pow(p - 1, 2) + neg * F.pow(p, 2)) / n).alias("brier"),
        (-F.sum(pos * F.log(pc) + neg * F.log(1 - pc)) / n).alias("log_loss"),
        (F.sum(pos) / n).alias("prevalence"))


def rank_metrics(counts: DataFrame, keys: list[str], *, bounded: bool | None = None) -> DataFrame:
    """ROC-AUC with tie handling and step-form average precision; null with one class."""
    run = running(counts, keys, ["p"], {"_cn": "n", "_cp": "pos"}, bounded=bounded)
    tot = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    both = run.join(tot, keys) if keys else run.join(F.broadcast(tot))  # one row
    neg = F.col("n") - F.col("pos")
    below = F.col("_cn") - F.col("_cp") - neg
    tp = F.col("_pos") - F.col("_cp") + F.col("pos")
    shown = F.col("_n") - F.col("_cn") + F.col("n")
    wins = F.sum(F.col("pos") * (below + neg / 2.0))
    # Summed as decimals: doubles would depend on the order in which shuffled rows arrive.
    step = F.try_divide(F.col("pos").cast("double"), F.col("_pos")) * F.try_divide(tp, shown)
    ap = F.sum(step.cast("decimal(38,20)")).cast("double")
    two = (F.max("_pos") > 0) & (F.max("_n") > F.max("_pos"))
    return both.groupBy(*keys).agg(
        F.when(two, F.try_divide(wins, F.max("_pos") * (F.max("_n") - F.max("_pos")))).alias("roc_auc"),
        F.when(two, ap).alias("pr_auc"))


def bin_of(p: Column, bins: int = ECE_BINS) -> Column:
    """Right-closed equal-width bin; 0 falls in bin 0."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e < p))


def reliability(counts: DataFrame, keys: list[str], bins: int = ECE_BINS) -> DataFrame:
    return (counts.groupBy(*keys, bin_of(F.col("p"), bins).alias("bin"))
            .agg(F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_p"),
                 (F.sum("pos") / F.sum("n")).alias("rate")))


def calibration(counts: DataFrame, keys: list[str], bins: int = ECE_BINS) -> DataFrame:
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return reliability(counts, keys, bins).groupBy(*keys).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def suite_of(counts: DataFrame, keys: list[str], *, threshold: float = 0.5, clip: float = 1e-15, bins: int = ECE_BINS) -> DataFrame:
    """Every metric from score counts, one row per key."""
    parts = [threshold_metrics(counts, keys, threshold), probability_metrics(counts, keys, clip), rank_metrics(counts, keys),
             calibration(counts, keys, bins)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys) if keys else out.join(F.broadcast(part))  # one row each
    return out


def suite(df: DataFrame, keys: list[str], *, y: str = "misheard", p: str = "score", **options) -> DataFrame:
    """Every metric of a score column, one row per key."""
    return suite_of(durable(score_counts(df, keys, y, p)), keys, **options)  # read by four metrics


def prevalence_floor(df: DataFrame, keys: list[str], y: str = "misheard") -> DataFrame:
    """Every metric of predicting the base rate everywhere: one distinct score per key."""
    base = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    return suite_of(base.withColumn("p", F.col("pos") / F.col("n")), keys)


def listener_ranking(df: DataFrame, keys: list[str], listener: str = "listener_id", *, y: str = "misheard", p: str = "score",
                     row: str = "row_id", bounded: bool | None = None) -> DataFrame:
    """Mean nDCG and mean average precision within listeners that misheard anything."""
    g = [*keys, listener]
    run = running(df.withColumn("_one", F.lit(1)), g, [F.col(p).desc(), row], {"_rn": "_one", "_hits": y}, bounded=bounded)
    gain = lambda at: F.sum(F.when(F.col(y) == 1, 1 / F.log2(F.col(at) + 1)))
    ndcg = run.groupBy(*g).agg(F.try_divide(gain("_rn"), gain("_hits")).alias("ndcg"), F.sum(y).alias("_pos"), F.count("*").alias("_n"))
    ap = rank_metrics(score_counts(df, g, y, p), g, bounded=bounded).select(*g, "pr_auc")
    per = ndcg.where("_pos > 0").join(ap, g, "left").withColumn("ap", F.coalesce("pr_auc", F.lit(1.0)))  # all positive
    return per.groupBy(*keys).agg(F.avg("ndcg").alias("ndcg_mean"), F.avg("ap").alias("map_mean"), F.count("*").alias("n_listeners_scored"))


def seed_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one seed), extremes and count; non-finite values dropped."""
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
                                 F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))


def contrast_summary(rows: DataFrame, keys: list[str], point: str = "point", excludes: str = "excludes_zero") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.avg(point).alias("difference"), F.count_if(F.col(excludes)).alias("n_seeds_excluding_zero"), F.count("*").alias("n_seeds"),
        (F.count_distinct(F.when(F.col(point) != 0, F.signum(point))) <= 1).alias("consistent_direction"))


# ---- bootstrap over listeners


#: Resamples that travel together, as one array of weights a listener.
WIDTH = 25


def draws(listeners: DataFrame, n_resamples: int, seed: int = 0, listener: str = "listener_id", *, bounded: bool | None = None) -> DataFrame:
    """How often each listener is drawn, in blocks of resamples: (blk, listener, w), where ``w[k]`` is of resample ``WIDTH * blk + k``.

    Numbers run through one resample after the other and a task draws one block, so draws are counted where they are
    made (``WIDTH`` four-byte counts a listener) and only counts are shuffled. A listener that a block never draws has
    no row in it; ``w`` is null beyond the last resample.
    """
    from phonrisk.functions.text import hash60

    who = durable(rank_rows(listeners.select(listener).distinct(), [], [listener], rn="_i", bounded=bounded))
    size, n_blocks = who.count(), -(-n_resamples // WIDTH)
    grid = (listeners.sparkSession.range(0, n_blocks * WIDTH * size, 1, max(n_blocks, 1))
            .select(F.expr(f"id div {size}").alias("b"), (F.col("id") % size).alias("_d")).where(F.col("b") < n_resamples))
    key = F.concat_ws(":", F.lit(f"boot{seed}"), F.col("b"), F.col("_d"))
    picked = grid.select("b", F.pmod(hash60(key), F.lit(size)).alias("_at"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            b, at = (batch.column(c).to_numpy() for c in ("b", "_at"))
            for blk in np.unique(b // WIDTH):
                mine = b // WIDTH == blk
                counts = held.setdefault(int(blk), np.zeros(size * WIDTH, np.int32))
                np.add.at(counts, at[mine] * WIDTH + b[mine] % WIDTH, 1)
        for blk, counts in held.items():
            k = min(WIDTH, n_resamples - blk * WIDTH)
            if counts.sum(dtype=np.int64) != k * size:
                raise ValueError(f"block {blk} of resamples was drawn in more than one task")
            counts = counts.reshape(size, WIDTH)
            drawn = np.flatnonzero(counts.any(axis=1))
            beyond = np.arange(WIDTH) >= k
            for lo in range(0, len(drawn), 10_000):
                some = drawn[lo:lo + 10_000]
                values = pa.array(counts[some].astype(np.int64).ravel(), mask=np.tile(beyond, len(some)))
                w = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * WIDTH), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), blk)), pa.array(some + 1), w], ["blk", "_i", "w"])

    return picked.mapInArrow(count, "blk bigint, _i bigint, w array<bigint>").join(who, "_i").drop("_i")


def resampled_sums(per: DataFrame, drawn: DataFrame, keys: list[str], values: list[str], listener: str = "listener_id") -> DataFrame:
    """Weighted sums of ``values`` (columns of a table by listener) per key and block: an array column each.

    The table meets each block once, not each resample, and is summed by key before its shuffle.
    """
    both = drawn.join(per, listener)
    sums = [F.sum(F.col("w")[k] * F.col(v)).alias(f"{v}{k}") for v in values for k in range(WIDTH)]
    out = both.groupBy(*keys, "blk").agg(F.min(F.size(F.filter("w", lambda x: x.isNotNull()))).alias("_k"), *sums)
    return out.select(*keys, "blk", "_k", *[F.array(*[F.col(f"{v}{k}") for k in range(WIDTH)]).alias(v) for v in values])


def per_resample(blocks: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row a resample: (keys, b, values)."""
    each = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda k: F.struct(
        (F.col("blk") * WIDTH + k).alias("b"), *[F.get(F.col(v), k).alias(v) for v in values]))
    return blocks.select(*keys, F.inline(each))


def intervals(values: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval over resamples; undefined ones are dropped and counted."""
    a = (1 - level) / 2
    return values.groupBy(*keys).agg(
        F.percentile(value, F.lit(a)).alias("lo"), F.percentile(value, F.lit(1 - a)).alias("hi"),  # one value a resample
        F.count(value).alias("n_valid"), F.count("*").alias("n_resamples"))


def excludes_zero(df: DataFrame) -> DataFrame:
    return df.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def bootstrap_statistic(df: DataFrame, sums: dict[str, Column], statistic: Column, drawn: DataFrame, keys: list[str], listener: str = "listener_id") -> DataFrame:
    """Any statistic of sums over rows, resampled: one row ``value`` per (keys, b).

    ``sums`` names what is summed over a resample's rows, ``statistic`` is an expression of those names.
    """
    per = df.groupBy(*keys, listener).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    blocks = resampled_sums(per, drawn, keys, list(sums), listener)
    return per_resample(blocks, keys, list(sums)).select(*keys, "b", statistic.alias("value"))


def bootstrap_ratio(df: DataFrame, num: Column, den: Column, drawn: DataFrame, keys: list[str], listener: str = "listener_id") -> DataFrame:
    """Resampled ratio of sums (recall, rate, Brier ...): one row per (keys, b)."""
    ratio = F.try_divide(F.col("_num").cast("double"), F.col("_den"))
    return bootstrap_statistic(df, {"_num": num, "_den": den}, ratio, drawn, keys, listener)


def bootstrap_rank(df: DataFrame, drawn: DataFrame, keys: list[str], *, y: str = "misheard", p: str = "score",
                   listener: str = "listener_id", bounded: bool | None = None) -> DataFrame:
    """Resampled AUC and average precision from weighted (listener, score) counts."""
    return resampled_rank(score_counts(df, [*keys, listener], y, p), drawn, keys, listener=listener, bounded=bounded)


#: Distinct scores of all keys up to which weighted counts are shuffled; beyond it rows are ranged by score and read in place.
MAX_SCORES = 20_000
#: Weights of a block of resamples that tasks hold at a time (two bytes each).
MAX_WEIGHTS = 48_000_000
#: Rows whose weights are looked up at once, and the weights of them that are summed at once.
SLAB, CELLS = 256, 128


def resampled_rank(per: DataFrame, drawn: DataFrame, keys: list[str], *, listener: str = "listener_id", bounded: bool | None = None,
                   few: bool | None = None) -> DataFrame:
    """``bootstrap_rank`` from counts per (keys, listener, score).

    Few distinct scores: weighted counts are summed by score before they are shuffled. Many: nothing is
    multiplied by the resamples (``_ranged_rank``).
    """
    if few is None:  # both forms give the same: about is enough
        few = per.agg(F.approx_count_distinct(F.xxhash64(*keys, "p"))).first()[0] <= MAX_SCORES
    return _summed_rank(per, drawn, keys, listener, bounded) if few else _ranged_rank(per, drawn, keys, listener)


def _summed_rank(per: DataFrame, drawn: DataFrame, keys: list[str], listener: str, bounded: bool | None) -> DataFrame:
    """A block's weighted counts are columns of one row a distinct score, so its resamples share one shuffle,
    one order and one pass of running sums.
    """
    by, each = [*keys, "blk"], range(WIDTH)
    both = drawn.join(per, listener)
    sums = [F.sum(F.col("w")[k] * F.col(v)).alias(f"{v}{k}") for v in ("n", "pos") for k in each]
    counts = durable(both.groupBy(*by, "p").agg(F.min(F.size(F.filter("w", lambda x: x.isNotNull()))).alias("_k"), *sums))  # read twice
    run = running(counts, by, ["p"], {f"_c{v}{k}": f"{v}{k}" for v in ("n", "pos") for k in each}, bounded=bounded)
    total = counts.groupBy(*by).agg(*[F.sum(f"{v}{k}").alias(f"_t{v}{k}") for v in ("n", "pos") for k in each])
    joined = run.join(total, by)

    def metrics(k: int) -> tuple[Column, Column]:
        n, pos, cn, cp, tn, tp = (F.col(c + str(k)) for c in ("n", "pos", "_cn", "_cpos", "_tn", "_tpos"))
        neg = n - pos
        wins = F.sum(pos * (cn - cp - neg + neg / 2.0))
        step = F.try_divide(pos.cast("double"), tp) * F.try_divide(tp - cp + pos, tn - cn + n)
        two = (F.max(tp) > 0) & (F.max(tn) > F.max(tp))
        return (F.when(two, F.try_divide(wins, F.max(tp) * (F.max(tn) - F.max(tp)))).alias(f"_roc{k}"),
                F.when(two, F.sum(step.cast("decimal(38,20)")).cast("double")).alias(f"_ap{k}"))  # decimals: the same in every order

    out = joined.groupBy(*by).agg(F.min("_k").alias("_k"), *[m for k in each for m in metrics(k)])
    arrays = [F.array(*[F.col(f"{c}{k}") for k in each]).alias(name) for c, name in (("_roc", "roc_auc"), ("_ap", "pr_auc"))]
    return per_resample(out.select(*by, "_k", *arrays), keys, ["roc_auc", "pr_auc"])


def _ranged_rank(per: DataFrame, drawn: DataFrame, keys: list[str], listener: str) -> DataFrame:
    """Rows are ranged by (key, score) over tasks once, packed into slabs and stay there; only listeners' weights
    of some resamples travel, as a broadcast of at most ``MAX_WEIGHTS`` numbers at a time.

    A first pass gives the totals of each range and resample, a second the sums within ranges, which start
    from the totals of the ranges before. Equal scores of a key lie in one range and one slab.
    """
    spark = per.sparkSession
    names = [tuple(r) for r in per.select(*keys).distinct().collect()] if keys else [()]  # a row a run
    names.sort(key=repr)
    number = spark.createDataFrame([(*n, i) for i, n in enumerate(names)], T.StructType([*[per.schema[k] for k in keys], T.StructField("_key", T.IntegerType())]))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    numbered = per.alias("l").join(F.broadcast(number.alias("r")), reduce(Column.__and__, same)) if keys else per.alias("l").join(F.broadcast(number.alias("r")))
    drawn = stored(drawn.select("blk", listener, F.col("w").cast("array<smallint>").alias("w")), "draws")  # drawn once, read three times
    who = durable(rank_rows(drawn.select(listener).distinct(), [], [listener], rn="_who"))  # never drawn: never counted
    parts = max(2 * spark.sparkContext.defaultParallelism, 16, -(-per.count() // 1_000_000))
    rows = numbered.select("_key", "p", F.col(f"l.{listener}").alias(listener), "n", "pos").join(who, listener).select(
        "_key", "p", (F.col("_who") - 1).cast("int").alias("_who"), F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))
    ranged = rows.repartitionByRange(parts, "_key", "p").sortWithinPartitions("_key", "p")
    slabs = durable(ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(_slabs, SLABS))
    size, n_blocks = who.count(), drawn.agg(F.max("blk")).first()[0] + 1
    step = max(1, min(n_blocks, MAX_WEIGHTS // (WIDTH * max(size, 1))))
    weights = stored(drawn.join(who, listener).select("blk", (F.col("_who") - 1).alias("_who"), "w"), "weights")
    return reduce(DataFrame.unionByName, [durable(_ranged_block(slabs, weights, names, number, keys, size, first, min(first + step, n_blocks)))
                                          for first in range(0, n_blocks, step)])


#: A slab: rows of one key in the order of their scores. ``heads`` are the places where a new score begins.
SLABS = "_part int, _key int, heads array<int>, who array<int>, n array<bigint>, pos array<bigint>"


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as slabs of up to ``SLAB`` rows of whole scores; a score of more rows (one a listener at most) is a slab alone."""
    schema = pa.schema([("_part", pa.int32()), ("_key", pa.int32()), ("heads", pa.list_(pa.int32())), ("who", pa.list_(pa.int32())),
                        ("n", pa.list_(pa.int64())), ("pos", pa.list_(pa.int64()))])
    fields, held = ("_part", "_key", "p", "_who", "n", "pos"), None

    def cut(c: dict[str, np.ndarray], heads: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        bounds = np.append(heads, end)
        keys, i = c["_key"][heads], 0
        while i < len(heads):
            same = i + np.searchsorted(keys[i:], keys[i], "right")
            j = min(max(np.searchsorted(bounds, bounds[i] + SLAB, "right") - 1, i + 1), same)
            lo, hi = bounds[i], bounds[j]
            of = [(heads[i:j] - lo).astype(np.int32), c["_who"][lo:hi], c["n"][lo:hi], c["pos"][lo:hi]]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (c["_part"][lo], c["_key"][lo], *of), strict=True))], schema)
            i = j

    for batch in batches:
        c = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in fields}
        if held is not None:
            c = {f: np.concatenate([held[f], c[f]]) for f in fields}
        if not len(c["p"]):
            continue
        heads = np.flatnonzero(np.r_[True, (c["_key"][1:] != c["_key"][:-1]) | (c["p"][1:] != c["p"][:-1])])
        yield from cut(c, heads[:-1], heads[-1])
        held = {f: v[heads[-1]:] for f, v in c.items()}  # the last score may go on in the next batch
    if held is not None:
        yield from cut(held, np.zeros(1, int), len(held["p"]))


def _each_slab(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, key, heads, who, n, pos) of each slab."""
    for batch in batches:
        lists = [batch.column(c) for c in ("heads", "who", "n", "pos")]
        for i, (part, key) in enumerate(zip(batch.column("_part").to_pylist(), batch.column("_key").to_pylist(), strict=True)):
            yield part, key, *[x[i].values.to_numpy() for x in lists]


def _weighted(w: np.ndarray, who: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows counted as often as each resample draws their listener; one count a row is left in two bytes."""
    drawn = w.take(who, axis=0)
    return drawn if (n == 1).all() else drawn * n[:, None]


def _slab_sum(w: np.ndarray, who: np.ndarray, n: np.ndarray) -> np.ndarray:
    return sum((_weighted(w, who[at:at + SLAB], n[at:at + SLAB]).sum(axis=0, dtype=np.int64) for at in range(0, len(who), SLAB)), np.zeros(w.shape[1], np.int64))


def _running(rows: np.ndarray) -> np.ndarray:
    """Sums of the rows before each row, and of all; of two bytes a row, ``SLAB`` rows stay within four."""
    out = np.zeros((len(rows) + 1, rows.shape[1]), np.int32 if rows.dtype == np.int16 else np.int64)
    np.cumsum(rows, axis=0, dtype=out.dtype, out=out[1:])
    return out


def _add_slab(w: np.ndarray, heads: np.ndarray, who: np.ndarray, n: np.ndarray, pos: np.ndarray, before: np.ndarray, whole: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` what the slab's scores add to average precision (times positives) and to wins; ``before`` is moved behind the slab.

    Only scores with a positive row add anything, so sums are looked up at those.
    """
    if len(heads) == 1:
        gn, gp = _slab_sum(w, who, n)[None], _slab_sum(w, who[pos > 0], pos[pos > 0])[None]
        en = ep = np.zeros_like(gn)
        total = np.array([gn[0], gp[0]])
    else:
        at = np.flatnonzero(pos)
        hit, first = np.unique(np.searchsorted(heads, at, "right") - 1, return_index=True)
        cn, cp = _running(_weighted(w, who, n)), _running(_weighted(w, who[at], pos[at]))
        en, ep = cn.take(heads[hit], axis=0), cp.take(first, axis=0)
        gn = cn.take(np.append(heads[1:], len(who))[hit], axis=0) - en
        gp = cp.take(np.append(first[1:], len(at)), axis=0) - ep
        total = np.array([cn[-1], cp[-1]])
    above = (whole[0] - before[0]) - en
    share = (whole[1] - before[1]) - ep
    share /= np.maximum(above, 1, out=above)  # nothing above: nothing drawn here
    share *= gp
    out[0] += share.sum(axis=0)
    below = np.subtract(2 * en + gn, 2 * ep + gp) * 0.5  # negatives below, and half of those beside
    below += before[0] - before[1]
    below *= gp
    out[1] += below.sum(axis=0)
    before += total


def _ranged_block(slabs: DataFrame, weights: DataFrame, names: list[tuple], number: DataFrame, keys: list[str], size: int, first: int, last: int) -> DataFrame:
    sc, width = slabs.sparkSession.sparkContext, WIDTH * (last - first)
    w, valid = np.zeros((size, width), dtype=np.int16), 0
    table = weights.where(F.col("blk").between(first, last - 1)).toArrow()  # at most MAX_WEIGHTS numbers, or one block
    if table.num_rows:
        drawn = pc.list_flatten(table["w"]).fill_null(-1).to_numpy().astype(np.int16).reshape(-1, WIDTH)
        at, to = table["_who"].to_numpy(), (table["blk"].to_numpy() - first) * WIDTH
        for k in range(WIDTH):
            w[at, to + k] = np.maximum(drawn[:, k], 0)
        valid = int((to[:, None] + np.arange(WIDTH))[drawn >= 0].max()) + 1  # beyond the last resample weights are null
    held = sc.broadcast([np.ascontiguousarray(w[:, lo:min(lo + CELLS, valid)]) for lo in range(0, valid, CELLS)])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for part, key, _, who, n, pos in _each_slab(batches):
            mine = sums.setdefault((part, key), np.zeros((2, valid)))
            for lo, part_w in zip(range(0, valid, CELLS), held.value, strict=True):
                mine[:, lo:lo + CELLS] += [_slab_sum(part_w, who, n), _slab_sum(part_w, who[pos > 0], pos[pos > 0])]
        rows = [{"_part": p, "_key": k, "n": v[0], "pos": v[1]} for (p, k), v in sums.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("_part", pa.int32()), ("_key", pa.int32()), ("n", pa.list_(pa.float64())), ("pos", pa.list_(pa.float64()))]))

    found = slabs.mapInArrow(totals, "_part int, _key int, n array<double>, pos array<double>").collect()  # a row a range and key
    before, whole = {}, np.zeros((len(names), 2, valid))
    for r in sorted(found, key=lambda r: (r["_key"], r["_part"])):
        before[r["_part"], r["_key"]] = whole[r["_key"]].copy()
        whole[r["_key"]] += np.array([r["n"], r["pos"]])
    start, full = sc.broadcast(before), sc.broadcast(whole)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over scores of what one score adds."""
        out: dict[int, np.ndarray] = {}
        at: dict[int, np.ndarray] = {}
        for part, key, heads, who, n, pos in _each_slab(batches):
            mine = out.setdefault(key, np.zeros((2, valid)))
            begun = at.setdefault(key, start.value[part, key].copy())
            for lo, part_w in zip(range(0, valid, CELLS), held.value, strict=True):
                cols = slice(lo, lo + CELLS)
                _add_slab(part_w, heads, who, n, pos, begun[:, cols], full.value[key][:, cols], mine[:, cols])
        for k, v in out.items():
            yield pa.RecordBatch.from_pydict({"_key": np.full(valid, k, np.int32), "b": np.arange(valid) + WIDTH * first, "ap": v[0], "wins": v[1]})

    of = slabs.mapInArrow(sums, "_key int, b long, ap double, wins double").groupBy("_key", "b").agg(
        F.sum(F.col("ap").cast("decimal(38,15)")).cast("double").alias("ap"), F.sum(F.col("wins").cast("decimal(38,4)")).cast("double").alias("wins"))
    flat = [(i, WIDTH * first + b, float(whole[i, 0, b]), float(whole[i, 1, b])) for i in range(len(names)) for b in range(valid)]
    sizes = slabs.sparkSession.createDataFrame(flat, "_key int, b long, _n double, _pos double")  # a row a run and resample
    two = (F.col("_pos") > 0) & (F.col("_n") > F.col("_pos"))
    return of.join(sizes, ["_key", "b"]).join(F.broadcast(number), "_key").select(
        *keys, "b", F.when(two, F.try_divide("wins", F.col("_pos") * (F.col("_n") - F.col("_pos")))).alias("roc_auc"),
        F.when(two, F.try_divide("ap", "_pos")).alias("pr_auc"))


def paired_difference(values: DataFrame, arm: str, a: str, b: str, value: str) -> DataFrame:
    """Difference of two arms on the same resamples: one row per b."""
    pick = lambda name: F.max(F.when(F.col(arm) == name, F.col(value)))
    return values.groupBy("b").agg((pick(a) - pick(b)).alias("value"))


def jitter(seed: int, row: str = "row_id") -> Column:
    return uniform(f"tie{seed}", F.col(row))
