"""Confusion counts and their smoothed estimates.

Counts stay long and sparse. The working form is one row per (listener, position, target):
68 rows a listener, each with a map of at most 29 perceived counts, so every estimate is
row-local arithmetic and only the count itself shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonrisk.functions import hangul as hg
from phonrisk.operators import dims

ALPHA = 1.0
GROUP_ALPHA = 5.0
CELL = ["position", "target", "perceived"]


def count_observations(obs: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Observations per (keys, position, target, perceived); partial sums before the shuffle."""
    n = F.sum(weight) if weight else F.count("*")
    return obs.groupBy(*keys, *CELL).agg(n.alias("n"))


def target_rows(counts: DataFrame, keys: list[str], owners: DataFrame | None = None) -> DataFrame:
    """Every target of every owner with its row total and counts by perceived index.

    ``owners`` adds owners without any observation. Output is dense over targets only. An owner's cells
    meet once, and its targets are made of them in its row: the observations are read once.
    """
    spark = counts.sparkSession
    idx = dims.perceived_index(F.col("position"), F.col("perceived"))
    counts = counts.repartition(*keys) if keys else counts  # at most 1,654 cells an owner; both groupings below keep this
    seen = counts.withColumn("_pi", idx).groupBy(*keys, "position", "target").agg(
        F.sum("n").alias("big_n"), F.map_from_entries(F.collect_list(F.struct("_pi", "n"))).alias("m"))  # <= 29
    dim = dims.dim_target(spark).select("position", "slot", F.col("idx").alias("t_idx"),
                                        F.col("symbol").alias("target"), "k")
    if keys:
        slot = F.broadcast(dim.select("position", "target", "slot"))  # 68 rows
        cell = F.when(F.col("slot").isNotNull(), F.struct("slot", F.struct("big_n", "m")))
        packed = seen.join(slot, ["position", "target"], "left").groupBy(*keys).agg(F.map_from_entries(F.collect_list(cell)).alias("_seen"))
        if owners is not None:
            packed = owners.select(*keys).distinct().join(packed, keys, "left")
        at = lambda i: F.try_element_at("_seen", i)
        each = F.transform(F.sequence(F.lit(0), F.lit(dims.N_TARGETS - 1)), lambda i: F.struct(
            i.alias("slot"), at(i)["big_n"].alias("big_n"), at(i)["m"].alias("m")))
        out = packed.select(*keys, F.inline_outer(each)).join(F.broadcast(dim), "slot")
        out = out.select(*keys, "position", "target", "slot", "t_idx", "k", "big_n", "m")
    else:
        out = dim.join(seen, ["position", "target"], "left")
    return (out.withColumn("big_n", F.coalesce("big_n", F.lit(0)))
            .withColumn("m", F.coalesce("m", F.create_map().cast("map<int,bigint>"))))


def _count_at(i: Column) -> Column:
    return F.coalesce(F.try_element_at("m", i), F.lit(0))


def dense(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Full alphabet with zeros: one row per (keys, position, target, perceived)."""
    symbols = (F.when(F.col("position") == "onset", F.lit(hg.ONSETS + "?"))
               .when(F.col("position") == "nucleus", F.lit(hg.NUCLEI + "?")).otherwise(F.lit(hg.CODAS + "?")))
    cells = rows.select(*keys, "position", "target", "t_idx", "k", "big_n", "m",
                        F.explode_outer(F.sequence(F.lit(0), F.col("k") - 1)).alias("p_idx"))
    return cells.select(*keys, "position", "target", "t_idx", F.substr(symbols, F.col("p_idx") + 1, F.lit(1)).alias("perceived"),
                        "p_idx", "k", "big_n", _count_at(F.col("p_idx")).alias("n"))


def undefined_rows(rows: DataFrame) -> DataFrame:
    """Target rows without observations, which only smoothing defines."""
    return rows.where("big_n = 0")


def check_smoothing(rows: DataFrame, alpha: float) -> None:
    """alpha = 0 leaves rows without observations undefined: name them and stop."""
    if alpha < 0:
        raise ValueError("alpha must be >= 0")
    if alpha == 0:
        empty = undefined_rows(rows).select("position", "target").distinct().limit(68).collect()
        if empty:
            names = ", ".join(sorted(f"{r.position}:{r.target}" for r in empty))
            raise ValueError(f"alpha=0 leaves rows with no observations undefined: {names}")


def with_probabilities(rows: DataFrame, *, alpha: float = ALPHA, prior: DataFrame | None = None) -> DataFrame:
    """Adds ``probs``: the smoothed distribution over perceived categories of each target row.

    ``prior`` is (position, target, prior ARRAY<DOUBLE>), 68 rows; without it, uniform. A target that
    the prior lacks keeps its row, with null ``probs``; ``bad_priors`` names it. ``alpha`` = 0 is
    refused where a row has no observations.
    """
    check_smoothing(rows, alpha)
    if prior is not None:
        rows = rows.join(F.broadcast(prior.select("position", "target", "prior")), ["position", "target"], "left")  # 68 rows
        at = lambda i: F.col("prior")[i]
    else:
        at = lambda i: 1.0 / F.col("k")
    spread = F.transform(F.sequence(F.lit(0), F.col("k") - 1),
                         lambda i: (_count_at(i) + F.lit(float(alpha)) * at(i)) / (F.col("big_n") + F.lit(float(alpha))))
    return rows.withColumn("probs", spread if prior is None else F.when(F.col("prior").isNotNull(), spread))


def posterior(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of ``probs`` with the raw counts beside it."""
    out = rows.select(*keys, "position", "target", "t_idx", "big_n", "m", F.posexplode_outer("probs").alias("p_idx", "p"))
    symbols = (F.when(F.col("position") == "onset", F.lit(hg.ONSETS + "?"))
               .when(F.col("position") == "nucleus", F.lit(hg.NUCLEI + "?")).otherwise(F.lit(hg.CODAS + "?")))
    return out.select(*keys, "position", "target", "t_idx", "big_n", F.substr(symbols, F.col("p_idx") + 1, F.lit(1)).alias("perceived"),
                      "p_idx", _count_at(F.col("p_idx")).alias("n"), "p")


def bad_priors(prior: DataFrame) -> DataFrame:
    """Prior rows that do not sum to one, are negative, have the wrong length, are unknown or missing."""
    d = dims.dim_target(prior.sparkSession).select("position", F.col("symbol").alias("target"), "k")
    total = F.aggregate("prior", F.lit(0.0), lambda a, x: a + x)
    bad = ((F.abs(total - 1) > 1e-9) | F.exists("prior", lambda x: x < 0) | (F.size("prior") != F.col("k")))
    return prior.join(d, ["position", "target"], "full_outer").where(bad | F.col("k").isNull() | F.col("prior").isNull())


def diagonal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """p_correct, confusability, evidence and row entropy (nats) per target."""
    p = F.col("probs")[F.col("t_idx")]
    h = -F.aggregate("probs", F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return rows.select(*keys, "position", "target", "t_idx", "slot", "big_n", p.alias("p_correct"),
                       (1 - p).alias("confusability"), h.alias("entropy"))


def wrong_answers(k: int) -> Column:
    """The k likeliest wrong answers of a target row (perceived, p, n), likeliest first, ties by alphabet index; none for k <= 0."""
    wrong = F.filter(
        F.transform("probs", lambda p, i: F.struct((-p).alias("neg"), i.alias("p_idx"))),
        lambda s: s["p_idx"] != F.col("t_idx"))
    symbols = (F.when(F.col("position") == "onset", F.lit(hg.ONSETS + "?"))
               .when(F.col("position") == "nucleus", F.lit(hg.NUCLEI + "?")).otherwise(F.lit(hg.CODAS + "?")))
    return F.transform(F.slice(F.array_sort(wrong), 1, max(k, 0)), lambda c: F.struct(
        F.substr(symbols, c["p_idx"] + 1, F.lit(1)).alias("perceived"), (-c["neg"]).alias("p"), _count_at(c["p_idx"]).alias("n")))


def top_confusions(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``wrong_answers`` of every target, a row each."""
    out = rows.select(*keys, "position", "target", F.posexplode(wrong_answers(k)).alias("_i", "c"))
    return out.select(*keys, "position", "target", (F.col("_i") + 1).alias("rank"), "c.perceived", "c.p", "c.n")


def empirical(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Unsmoothed row proportions of the observed cells."""
    w = Window.partitionBy(*keys, "position", "target")  # at most 29 rows
    return counts.select(*keys, *CELL, "n", F.try_divide("n", F.sum("n").over(w)).alias("p"))


def pool(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts summed over listeners."""
    return counts.groupBy(*(by or []), *CELL).agg(F.sum("n").alias("n"))


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Observed share of each alphabet, observations and accuracy per owner and position."""
    hit = _count_at(F.col("t_idx"))
    return rows.groupBy(*keys, "position").agg(
        F.sum("big_n").alias("n_observations"), F.sum(hit).alias("n_correct"),
        (F.sum(F.when(F.col("big_n") > 0, 1).otherwise(0)) / F.count("*")).alias("coverage"))


def accuracy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Position-level accuracy (null without evidence) and global error (0.5 without)."""
    right = F.sum(F.when(F.col("target") == F.col("perceived"), F.col("n")).otherwise(0))
    acc = F.try_divide(right, F.sum("n"))
    return counts.groupBy(*keys).agg(acc.alias("accuracy"), F.coalesce(1 - acc, F.lit(0.5)).alias("global_error"))


def profile_stats(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n_trials"),
        F.sum(F.when(F.col("trial_error") == "no_response", 1).otherwise(0)).alias("n_unusable"))


def as_prior(rows: DataFrame) -> DataFrame:
    """Turn pooled target rows (no owner) into a prior table."""
    return with_probabilities(rows).select("position", "target", F.col("probs").alias("prior"))


def group_prior(counts: DataFrame) -> DataFrame:
    """Population prior: pooled counts smoothed with alpha 1."""
    return as_prior(target_rows(pool(counts), []))


def prior_contributors(counts: DataFrame, owner: str = "listener_id") -> DataFrame:
    """Who a prior was fitted from, as rows (the list itself may be long)."""
    return counts.select(owner).distinct()


def shrink(rows: DataFrame, prior: DataFrame, alpha: float = GROUP_ALPHA) -> DataFrame:
    """Re-smooth toward a prior; the counts stay as they are."""
    return with_probabilities(rows.drop("probs"), alpha=alpha, prior=prior)


def shrinkage_report(rows: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """How far p_correct moved on average, for unobserved and well observed targets."""
    both = shrink(rows, prior).withColumn("_s", F.col("probs")[F.col("t_idx")]).drop("probs", "prior")
    both = with_probabilities(both).withColumn("_o", F.col("probs")[F.col("t_idx")])
    moved = F.abs(F.col("_s") - F.col("_o"))
    return both.groupBy(*keys, "position").agg(
        F.avg(F.when(F.col("big_n") == 0, moved)).alias("mean_move_unobserved"),
        F.avg(F.when(F.col("big_n") >= 10, moved)).alias("mean_move_well_observed"))


def layout(counts: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Matrix layout of one position: target rows, perceived columns ``p00``.. in alphabet order."""
    size = len(hg.ALPHABET[position]) + 1
    idx = dims.perceived_index(F.lit(position), F.col("perceived"))
    named = counts.where(F.col("position") == position).withColumn("_c", F.format_string("p%02d", idx))
    cols = [f"p{i:02d}" for i in range(size)]
    return named.groupBy(*keys, "target").pivot("_c", cols).agg(F.sum("n")).na.fill(0, cols)


def profile_digest(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Digest that changes whenever a listener's counts change (at most 1,654 cells each)."""
    cell = F.concat_ws("|", *CELL, F.col("n").cast("string"))
    text = F.array_join(F.array_sort(F.collect_list(cell)), ";")
    return counts.groupBy(*keys).agg(F.substring(F.sha2(text, 256), 1, 16).alias("digest"))
