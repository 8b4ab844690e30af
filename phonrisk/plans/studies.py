"""Studies over many cells: tidy tables of (seed, arm, model, slice) rows and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonrisk.operators import metrics as mt
from phonrisk.operators import policy as po
from phonrisk.operators.ordered import is_bounded, quantile, rank_rows
from phonrisk.session import durable


# The arms that are compared by default, each with its reference.
DEFAULT_CONTRASTS = (
    ("clinical_plus_confusion", "clinical"),
    ("clinical_plus_confusion", "pta_only"),
    ("confusion_only", "clinical"),
    ("clinical_plus_confusion", "word_context_only"),
)


def contrasts(points: DataFrame, resampled: DataFrame, keys: list[str], value: str, pairs: Sequence[tuple[str, str]] = DEFAULT_CONTRASTS, *,
              arm: str = "arm", level: float = 0.95) -> DataFrame:
    """Differences ``arm`` - ``reference`` per key with the paired interval over resamples.

    ``points`` holds (keys, arm, value), ``resampled`` (keys, arm, b, value) of the same draws for all
    arms. A pair is left out where an arm of it was not run. Adds point, lo, hi, n_valid,
    n_resamples and excludes_zero (null without a valid resample).
    """
    each = F.array(*[F.struct(F.lit(a).alias("_arm"), F.lit(r).alias("reference")) for a, r in pairs])

    def differences(rows: DataFrame, by: list[str]) -> DataFrame:
        held = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(arm, F.struct(value)))).alias("_m"))  # one entry an arm
        long = held.select(*by, "_m", F.inline(each)).where(F.map_contains_key("_m", F.col("_arm")) & F.map_contains_key("_m", F.col("reference")))
        at = lambda c: F.try_element_at("_m", F.col(c))[value]
        return long.select(*by, F.col("_arm").alias("arm"), "reference", (at("_arm") - at("reference")).alias("_d"))

    who = [*keys, "arm", "reference"]
    spread = mt.intervals(differences(resampled, [*keys, "b"]), who, "_d", level)
    return mt.excludes_zero(differences(points, keys).withColumnRenamed("_d", "point").join(spread, who, "left"))


def paired(rows: DataFrame, arm: str, a: str, b: str, value: str, seed: str = "seed") -> DataFrame:
    """Per-seed difference of two arms: mean, sample deviation, wins."""
    pick = lambda name: F.max(F.when(F.col(arm) == name, F.col(value)))
    d = rows.groupBy(seed).agg((pick(a) - pick(b)).alias("_d")).where("_d is not null")
    return d.agg(F.count("*").alias("n_seeds"), F.avg("_d").alias("mean"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("sd"),
                 F.count_if(F.col("_d") > 0).alias("n_positive"))


def misaligned(a: DataFrame, b: DataFrame, row: str, label: str) -> DataFrame:
    """Rows present in only one of two results, or labelled differently."""
    left = a.select(row, F.col(label).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(row, F.col(label).alias("_b"), F.lit(True).alias("_in_b"))
    return left.join(right, row, "full_outer").where("_in_a is null or _in_b is null or _a <> _b").select(row)


def missing_cells(produced: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Declared grid cells that were not produced (must be empty). The grid is a config, not data."""
    spark = produced.sparkSession
    grid = reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*[F.lit(v) for v in kv[1]]))), axes.items(), spark.range(1)).drop("id")
    return grid.select(*axes).subtract(produced.select(*axes))


def require_complete(produced: DataFrame, axes: dict[str, list]) -> None:
    gaps = missing_cells(produced, axes).limit(5).collect()
    if gaps:
        raise ValueError(f"declared cells were not produced, for example {gaps}")


def summarise(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Long table of mean / sd / min / max / n per (keys, metric); non-finite values dropped."""
    long = rows.select(*keys, F.inline_outer(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])))
    return mt.seed_summary(long, [*keys, "metric"], "value")


def best_arm(rows: DataFrame, arm: str, value: str) -> DataFrame:
    means = rows.groupBy(arm).agg(F.avg(value).alias("_m"))
    return means.agg(F.max_by(arm, F.struct("_m", arm)).alias("best_arm"), F.max("_m").alias("best_mean"))


def every_seed_winners(rows: DataFrame, keys: list[str], gain: str) -> DataFrame:
    """Candidates and whether they beat the comparator on every seed."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_seeds"), F.count_if(F.col(gain) > 0).alias("n_seeds_beating"), F.avg(gain).alias("mean_gain"))
    return out.withColumn("beats_every_seed", F.col("n_seeds") == F.col("n_seeds_beating"))


# ---- listener slices


def band(value: Column, edges: tuple[float, float], labels: tuple[str, str, str]) -> Column:
    return (F.when(value.isNull(), "unknown").when(value < edges[0], labels[0]).when(value < edges[1], labels[1]).otherwise(labels[2]))


# The band edges and labels below.


def listener_subgroups(hearing: DataFrame, stats: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Severity, WRS, usable-evidence and accuracy bands with edges fixed beforehand."""
    df = hearing.join(stats, "listener_id", "full_outer").join(accuracy, "listener_id", "full_outer")
    usable = 1 - F.col("n_unusable") / F.greatest(F.col("n_trials"), F.lit(1))
    return df.select(
        "listener_id", F.coalesce("severity_who", F.lit("unknown")).alias("severity"),
        band(F.col("mean_wrs"), (60.0, 80.0), ("wrs_low", "wrs_mid", "wrs_high")).alias("wrs_band"),
        band(usable, (0.95, 0.99), ("usable_low", "usable_mid", "usable_high")).alias("evidence_band"),
        band(F.col("accuracy"), (0.55, 0.8), ("acc_low", "acc_mid", "acc_high")).alias("idiosyncrasy_band"))


def sliced(df: DataFrame, axes: list[str]) -> DataFrame:
    """Each row once overall and once per axis: (slice_axis, slice_value)."""
    parts = [F.struct(F.lit("overall").alias("slice_axis"), F.lit("all").alias("slice_value"))]
    parts += [F.struct(F.lit(a).alias("slice_axis"), F.col(a).cast("string").alias("slice_value")) for a in axes]
    return df.select("*", F.inline_outer(F.array(*parts)))


def additive_slices(df: DataFrame, axes: list[str], y: str = "misheard", p: str = "score") -> DataFrame:
    """Row counts, prevalence and Brier score by grouping sets: one scan, no row copies in the plan's input."""
    view = df.select(*axes, y, F.pow(F.col(p) - F.col(y), 2).alias("_b"))
    sets = [[], *[[F.col(a)] for a in axes]]
    g = view.groupingSets(sets, *[F.col(a) for a in axes]).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n_rows"), F.avg(y).alias("prevalence"), F.avg("_b").alias("brier"))
    n = len(axes)
    axis, value = F.lit("overall"), F.lit("all")
    for i, a in enumerate(axes):
        only = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        axis = F.when(F.col("_g") == only, a).otherwise(axis)
        value = F.when(F.col("_g") == only, F.col(a).cast("string")).otherwise(value)
    return g.select(axis.alias("slice_axis"), value.alias("slice_value"), "n_rows", "prevalence", "brier")


def slice_rank_metrics(df: DataFrame, axes: list[str]) -> DataFrame:
    keys = ["slice_axis", "slice_value"]
    c = mt.score_counts(sliced(df, axes), keys)
    return mt.rank_metrics(c, keys).join(mt.calibration(c, keys), keys)


def slice_recall(df: DataFrame, axes: list[str], budgets: tuple[float, ...], *, word: str = "word", listener_axes: Sequence[str] = (),
                 listener: str = "listener_id", row: str = "row_id", y: str = "misheard", score: str = "score") -> DataFrame:
    """Recall of the model and of word length per slice and budget, with the listener spread.

    ``listener_axes`` are those of ``axes`` that are the same in all rows of a listener. Such slices, and
    the overall one, hold whole listeners, so they are sums of totals from one ranking within listeners;
    every other axis is ranked once within (slice, listener). No row is copied.
    """
    own, keys = [a for a in axes if a in set(listener_axes)], ["slice_axis", "slice_value"]
    scores = {"recall": score, "word_length_recall": "_len"}
    rows = durable(df.withColumn("_len", F.char_length(word).cast("double")).select(row, listener, y, *dict.fromkeys(scores.values()), *axes))
    bounded = is_bounded(rows, [listener])  # and so is every part of a listener
    names = {f"b{i}": b for i, b in enumerate(budgets)}
    flags = {k: po.within(b) for k, b in names.items()}

    def totals(by: list[str], which: str) -> DataFrame:
        ranked = po.ranked_for_budget(rows, [*by, listener], score=scores[which], bounded=bounded)
        return po.listener_totals(ranked, flags, [*by, listener]).withColumn("_which", F.lit(which))

    parts = []
    for which in scores:
        whole = totals(own, which)  # a listener's attributes go along with its totals
        parts.append(sliced(whole, own).drop(*own))
        parts += [totals([a], which).select(F.lit(a).alias("slice_axis"), F.col(a).cast("string").alias("slice_value"), "*").drop(a) for a in axes if a not in own]
    both = po.points(reduce(DataFrame.unionByName, parts), names, ["_which", *keys])
    kept = ["misheard_recall", "recall_median", "recall_min", "recall_q25", "frac_near_zero"]
    wide = both.groupBy(*keys, "budget").agg(*[F.max(F.when(F.col("_which") == w, F.struct(*kept))).alias(f"_{w}") for w in scores])  # a row each
    of = lambda w, c: F.col(f"_{w}.{c}")
    return wide.select(*keys, "budget", of("recall", "misheard_recall").alias("recall"), of("recall", "recall_median").alias("recall_median"),
                       of("recall", "recall_min").alias("recall_worst"), of("recall", "recall_q25").alias("recall_q25"), of("recall", "frac_near_zero").alias("frac_near_zero"),
                       of("word_length_recall", "misheard_recall").alias("word_length_recall")).withColumn("gain", F.col("recall") - F.col("word_length_recall"))


def condition_gain(gains: DataFrame, condition: str = "snr_db") -> DataFrame:
    """Overall gain beside the mean and least gain inside each condition."""
    inside = gains.where(F.col("slice_axis") == condition).groupBy("budget").agg(
        F.avg("gain").alias("gain_within_condition_mean"), F.min("gain").alias("gain_within_condition_min"))
    return gains.where("slice_axis = 'overall'").select("budget", F.col("gain").alias("gain_overall")).join(inside, "budget")


def monotone(gains: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the gain never falls as the budget grows (a handful of budgets per key)."""
    w = Window.partitionBy(*keys).orderBy("budget")
    prev = gains.withColumn("_p", F.lag("gain").over(w))
    return prev.groupBy(*keys).agg(F.every(F.coalesce(F.col("gain") >= F.col("_p") - 1e-12, F.lit(True))).alias("is_monotone_increasing"))


def smallest_winning_length(rows: DataFrame, length: str = "calibration_length", gain: str = "gain") -> DataFrame:
    wins = every_seed_winners(rows, [length], gain).where("beats_every_seed")
    return wins.agg(F.min(length).alias("min_calibration_length"))


def take_first_trials(trials: DataFrame, lengths: tuple[int, ...], *, listener: str = "listener_id", order: str = "trial_id", bounded: bool | None = None) -> DataFrame:
    """Trials of every evidence length: the first n per listener, keyed by ``calibration_length``."""
    ranked = rank_rows(trials, [listener], [order], rn="_rn", bounded=bounded)
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n >= F.col("_rn"))
    return ranked.select(*trials.columns, F.explode_outer(fits).alias("calibration_length")).where("calibration_length is not null")


# ---- run log


def current_runs(log: DataFrame) -> DataFrame:
    """Latest entry of every run of an append-only log."""
    latest = F.max_by(F.struct(*[c for c in log.columns if c != "run_id"]), F.struct("logged_at", "entry_id"))
    return log.groupBy("run_id").agg(latest.alias("_e")).select("run_id", "_e.*")


def run_collisions(log: DataFrame) -> DataFrame:
    """Run ids opened with two different start times (refused)."""
    return log.groupBy("run_id").agg(F.count_distinct("started_at").alias("n_starts")).where("n_starts > 1")


def latest_completed(log: DataFrame, name: str = "name") -> DataFrame:
    done = current_runs(log).where("status = 'completed'")
    return done.groupBy(name).agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


# ---- two models side by side


def complementarity(df: DataFrame, a: str, b: str, *, budget: float = 0.2, listener: str = "listener_id", y: str = "misheard") -> DataFrame:
    """Residual correlation, within-listener rank correlation and overlap of the top share."""
    resid = df.agg(F.corr(F.col(y) - F.col(a), F.col(y) - F.col(b)).alias("residual_correlation"))
    ra = po.ranked_for_budget(df.select("row_id", listener, y, a, b), [listener], score=a, seed=None).withColumnsRenamed({"rn": "_ra", "n_group": "_n"})
    both = po.ranked_for_budget(ra, [listener], score=b, seed=None).withColumnsRenamed({"rn": "_rb"})
    cut = F.rint(F.lit(budget) * F.col("_n"))
    in_a, in_b = F.col("_ra") <= cut, F.col("_rb") <= cut
    per = both.groupBy(listener).agg(
        F.corr("_ra", "_rb").alias("_rho"), F.count_if(in_a & in_b).alias("_both"), F.count_if(in_a).alias("_na"),
        F.sum(F.when(in_b & ~in_a, F.col(y)).otherwise(0)).alias("_won"), F.sum(F.when(in_a & ~in_b, F.col(y)).otherwise(0)).alias("_lost"))
    per = durable(per)  # read twice; one row a listener
    middle = quantile(per, [], "_rho", 0.5, out="median_rank_correlation")
    tot = per.agg(F.try_divide(F.sum("_both").cast("double"), F.sum("_na")).alias("top_overlap"),
                  (F.sum("_won") - F.sum("_lost")).alias("net_recovered"))
    return resid.join(F.broadcast(middle)).join(F.broadcast(tot))  # one row each


def rounded(rows: DataFrame, digits: dict[str, int], order: list[Column]) -> DataFrame:
    """Report table: fixed columns, rounded, ordered."""
    return rows.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in rows.columns]).orderBy(*order)


