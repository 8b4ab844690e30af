"""Which words to caption: budgets, thresholds and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonrisk.functions.text import uniform
from phonrisk.operators import metrics as mt
from phonrisk.operators.ordered import is_bounded, quantile, rank_rows, running

BUDGETS = (0.10, 0.20, 0.30, 0.40, 0.50)


def _uncertain(floor: float | None) -> Column:
    if floor is None:
        return F.lit(False)
    return F.coalesce(F.col("confidence") < floor, F.lit(False))


def full_policy(words: DataFrame) -> DataFrame:
    return words.withColumns({"decision": F.lit("shown_full"), "policy": F.lit("full")})


def threshold_policy(words: DataFrame, tau: float, floor: float | None = None, risk: str = "listener_risk") -> DataFrame:
    """Strictly above ``tau``; recogniser doubt is its own decision, never part of the risk."""
    label = f"threshold(tau={tau:.2f})" + (f"+asr_floor({floor:.2f})" if floor is not None else "")
    decision = F.when(F.col(risk) > tau, "shown_high_risk").when(_uncertain(floor), "shown_low_asr_confidence").otherwise("hidden")
    return words.withColumns({"decision": decision, "policy": F.lit(label)})


def budget_policy(words: DataFrame, budget: float, floor: float | None = None, *, media: str = "media_id", risk: str = "listener_risk",
                  bounded: bool | None = None) -> DataFrame:
    """The riskiest ``rint(budget * n)`` words of each media; ties by start time, then order."""
    label = f"budget(B={budget:.2f})" + (f"+asr_floor({floor:.2f})" if floor is not None else "")
    ranked = rank_rows(words, [media], [F.col(risk).desc(), "start_s", "tok_idx"], rn="_rn", total="_n", bounded=bounded)
    chosen = F.col("_rn") <= F.rint(F.lit(float(budget)) * F.col("_n"))
    decision = F.when(chosen, "shown_high_risk").when(_uncertain(floor), "shown_low_asr_confidence").otherwise("hidden")
    return ranked.withColumns({"decision": decision, "policy": F.lit(label)}).drop("_rn", "_n")


#: Named caption policies: functions of a words table that add ``decision`` and ``policy``.
POLICIES: dict[str, Callable[..., DataFrame]] = {"full": full_policy, "threshold": threshold_policy, "budget": budget_policy}
DECISIONS = ("shown_full", "shown_high_risk", "shown_low_asr_confidence", "hidden")


def register_policy(name: str, policy: Callable[..., DataFrame]) -> None:
    """Make a policy known by a name that is not taken."""
    if name in POLICIES:
        raise ValueError(f"policy {name} is registered already")
    POLICIES[name] = policy


def apply_policy(words: DataFrame, name: str, **options) -> DataFrame:
    """Run a named policy and hold it to its contract: every word as it was, ``decision`` and ``policy`` beside it.

    A decision that is not one of ``DECISIONS`` stops the job when it is read.
    """
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name}, not one of {sorted(POLICIES)}")
    out = POLICIES[name](words, **options)
    if lost := [c for c in (*words.columns, "decision") if c not in out.columns]:
        raise ValueError(f"policy {name} lost columns {lost}")
    label = F.col("policy") if "policy" in out.columns else F.lit(name)
    bad = F.raise_error(F.concat(F.lit(f"policy {name} made decision "), F.coalesce("decision", F.lit("null"))))
    checked = F.when(F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), F.col("decision")).otherwise(bad.cast("string"))
    return out.select(*words.columns, checked.alias("decision"), label.alias("policy"))


def is_shown() -> Column:
    return F.col("decision").startswith("shown")


def caption_ratio(words: DataFrame, keys: list[str]) -> DataFrame:
    share = F.avg(is_shown().cast("double"))
    return words.groupBy(*keys).agg(share.alias("caption_ratio"), (1 - share).alias("caption_reduction_ratio"))


def thresholds(df: DataFrame, keys: list[str], ratio: float, score: str = "score", *, weight: str | None = None,
               bounded: bool | None = None) -> DataFrame:
    """Per-key (or pooled) threshold showing ``ratio`` of the scores; use with ``>=``.

    ``weight`` counts rows when ``df`` already holds one row per distinct score.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("target ratio must be in [0, 1]")
    if ratio in (0.0, 1.0):
        return df.groupBy(*keys).agg(F.lit(1.0 - ratio).alias("tau")) if keys else df.agg(F.lit(1.0 - ratio).alias("tau"))
    return quantile(df, keys, score, 1.0 - ratio, out="tau", weight=weight, bounded=bounded)


def ranked_for_budget(df: DataFrame, keys: list[str], *, score: str = "score", row: str = "row_id", seed: int | None = 0,
                      bounded: bool | None = None) -> DataFrame:
    """Rank by score once; every budget is then a comparison. Ties by seeded hash, or by row."""
    tie = [F.col("_tie"), F.col(row)] if seed is not None else [F.col(row)]
    src = df.withColumn("_tie", uniform(f"tie{seed}", F.col(row))) if seed is not None else df
    out = rank_rows(src, keys, [F.col(score).desc(), *tie], rn="rn", total="n_group", bounded=bounded)
    return out.drop("_tie")


def within(budget: float | Column) -> Column:
    b = F.lit(float(budget)) if isinstance(budget, (int, float)) else budget
    return F.col("rn") <= F.rint(b * F.col("n_group"))


def boundary_ties(df: DataFrame, keys: list[str], budget: float, score: str = "score", *, bounded: bool | None = None) -> DataFrame:
    """How many rows share the score of the last selected one (0 when all or none are selected)."""
    c = df.groupBy(*keys, score).agg(F.count("*").alias("_c"))
    run = running(c.withColumn("_neg", -F.col(score)), keys, ["_neg"], {"_to": "_c"}, bounded=bounded)
    tot = c.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    both = run.join(tot, keys) if keys else run.join(F.broadcast(tot))  # one row
    cut = F.rint(F.lit(float(budget)) * F.col("_n"))
    at = (F.col("_to") - F.col("_c") < cut) & (cut <= F.col("_to")) & (cut > 0) & (cut < F.col("_n"))
    return both.groupBy(*keys).agg(F.max(F.when(at, F.col("_c")).otherwise(0)).alias("n_ties"))


def listener_totals(selected: DataFrame, flags: dict[str, Column], keys: list[str], y: str = "misheard") -> DataFrame:
    """Rows, positives, and per flag the shown rows and hits of every (keys, listener)."""
    aggs = [F.count("*").alias("n"), F.sum(y).alias("n_pos")]
    for name, flag in flags.items():
        aggs += [F.count_if(flag).alias(f"shown_{name}"), F.sum(F.when(flag, F.col(y)).otherwise(0)).alias(f"hits_{name}")]
    return selected.groupBy(*keys).agg(*aggs)


def points(totals: DataFrame, names: dict[str, float], keys: list[str]) -> DataFrame:
    """One row per (keys, flag): recall, precision, missed rate, volume and listener spread.

    The listener percentiles run over hits/positives ratios; their distinct values are bounded
    by words per listener, not by the number of listeners.
    """
    each = F.array(*[F.struct(F.lit(float(v)).alias("budget"), F.col(f"shown_{k}").alias("shown"), F.col(f"hits_{k}").alias("hits"))
                     for k, v in names.items()])
    long = totals.select(*keys, "n", "n_pos", F.inline_outer(each)).withColumn("_r", F.try_divide(F.col("hits").cast("double"), F.col("n_pos")))
    hits, shown, n, pos = F.sum("hits").cast("double"), F.sum("shown").cast("double"), F.sum("n"), F.sum("n_pos")
    return long.groupBy(*keys, "budget").agg(
        (shown / n).alias("achieved_ratio"), (1 - shown / n).alias("caption_reduction_ratio"), F.try_divide(hits, pos).alias("misheard_recall"),
        F.try_divide(hits, shown).alias("precision"), ((pos - hits) / n).alias("missed_rate"), n.alias("n_words"), pos.alias("n_misheard"),
        F.min("_r").alias("recall_min"), F.percentile("_r", F.lit(0.5)).alias("recall_median"), F.max("_r").alias("recall_max"),
        F.percentile("_r", F.lit(0.25)).alias("recall_q25"), F.avg((F.col("_r") < 0.05).cast("double")).alias("frac_near_zero"))


def recall_intervals(totals: DataFrame, names: dict[str, float], keys: list[str], drawn: DataFrame, listener: str = "listener_id") -> DataFrame:
    """Percentile interval of pooled recall per budget, over listeners drawn again and again.

    Starts from one row of totals a listener; rows do not travel with the resamples.
    """
    each = F.array(*[F.struct(F.lit(float(v)).alias("budget"), F.col(f"hits_{k}").alias("hits")) for k, v in names.items()])
    long = totals.select(*keys, listener, "n_pos", F.inline(each))
    drawn_recall = mt.bootstrap_ratio(long, F.col("hits"), F.col("n_pos"), drawn, [*keys, "budget"], listener)
    return mt.intervals(drawn_recall, [*keys, "budget"], "value").withColumnsRenamed({"lo": "recall_lo", "hi": "recall_hi"})


def frontier(df: DataFrame, keys: list[str], *, per_listener: bool = True, budgets: tuple[float, ...] = BUDGETS, score: str = "score",
             listener: str = "listener_id", seed: int | None = 0, bounded: bool | None = None) -> DataFrame:
    """Budget points of one ranking; ranked once for all budgets."""
    ranked = ranked_for_budget(df, [*keys, listener] if per_listener else keys, score=score, seed=seed, bounded=bounded)
    names = {f"b{i}": b for i, b in enumerate(budgets)}
    tot = listener_totals(ranked, {k: within(b) for k, b in names.items()}, [*keys, listener])
    return points(tot, names, keys)


def strategy_scores(df: DataFrame, *, word: str = "word", score: str = "score", seed: int = 0) -> DataFrame:
    """Rows of every strategy: random, word length (min-max scaled), model."""
    span = df.agg(F.min(F.char_length(word)).alias("_lo"), F.max(F.char_length(word)).alias("_hi"))
    both = df.join(F.broadcast(span))  # one row
    length = F.coalesce(F.try_divide((F.char_length(word) - F.col("_lo")).cast("double"), F.col("_hi") - F.col("_lo")), F.lit(0.5))
    each = F.array(
        F.struct(F.lit("random").alias("strategy"), uniform(f"random{seed}", F.col("row_id")).alias("strategy_score")),
        F.struct(F.lit("word_length").alias("strategy"), length.alias("strategy_score")),
        F.struct(F.lit("model").alias("strategy"), F.col(score).alias("strategy_score")))
    return both.select(*df.columns, F.inline_outer(each))


def compare_thresholds(df: DataFrame, ratio: float, *, listener: str = "listener_id", score: str = "score", y: str = "misheard") -> DataFrame:
    """Pooled and per-listener selection at equal volume, with the equity summary."""
    fits = is_bounded(df, [listener])
    pooled = ranked_for_budget(df, [], score=score, seed=None)
    own = ranked_for_budget(df, [listener], score=score, seed=None, bounded=fits)
    rows = []
    for name, ranked in (("global", pooled), ("personalized", own)):
        tot = listener_totals(ranked, {"x": within(ratio)}, [listener], y)
        rows.append(points(tot, {"x": ratio}, []).withColumn("mode", F.lit(name)))
    return rows[0].unionByName(rows[1])


def rate_threshold(df: DataFrame, keys: list[str], rate: float, score: str = "score", *, weight: str | None = None,
                   bounded: bool | None = None) -> DataFrame:
    """Threshold for a caption rate and the share of boundary ties to let through."""
    tau = thresholds(df, keys, rate, score, weight=weight, bounded=bounded)
    c = df.groupBy(*keys, score).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    both = c.join(tau, keys) if keys else c.join(F.broadcast(tau))  # one row
    at = F.abs(F.col(score) - F.col("tau")) <= 1e-12
    shares = both.groupBy(*keys).agg(
        F.max("tau").alias("tau"), (F.sum(F.when(F.col(score) > F.col("tau"), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("_above"),
        (F.sum(F.when(at, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("_at"))
    need = F.greatest(F.lit(0.0), F.lit(float(rate)) - F.col("_above"))
    return shares.select(*keys, "tau", F.coalesce(F.least(F.lit(1.0), F.try_divide(need, F.col("_at"))), F.lit(0.0)).alias("tie_pass_fraction"))


def fold_thresholds(df: DataFrame, folds: DataFrame, rate: float, *, score: str = "score", listener: str = "listener_id") -> DataFrame:
    """Threshold of every fold from its training listeners only.

    Score counts per fold are small; a fold's training counts are all counts minus its own.
    """
    own = df.join(folds, listener).groupBy("fold", score).agg(F.count("*").alias("_own"))
    every = own.groupBy(score).agg(F.sum("_own").alias("_all"))
    grid = every.join(F.broadcast(folds.select("fold").distinct()))  # one row a fold
    train = grid.join(own, ["fold", score], "left").select("fold", score, (F.col("_all") - F.coalesce("_own", F.lit(0))).alias("_w")).where("_w > 0")
    return rate_threshold(train, ["fold"], rate, score, weight="_w")


def passes(score: str = "score", *parts: str) -> Column:
    """Strictly above passes; a boundary tie passes when its hash falls under the fraction."""
    at = F.abs(F.col(score) - F.col("tau")) <= 1e-12
    u = uniform("tie", *[F.col(p) for p in parts])
    return F.when(at, u < F.col("tie_pass_fraction")).otherwise(F.col(score) > F.col("tau"))


def threshold_points(df: DataFrame, taus: tuple[float, ...], keys: list[str], *, listener: str = "listener_id", score: str = "score") -> DataFrame:
    """Plain ``>= tau`` grid: rate, recall, precision, F1, listener spread, near-empty share."""
    names = {f"t{i}": v for i, v in enumerate(taus)}
    tot = listener_totals(df, {k: F.col(score) >= v for k, v in names.items()}, [*keys, listener])
    each = F.array(*[F.struct(F.lit(float(v)).alias("threshold"), F.col(f"shown_{k}").alias("shown"), F.col(f"hits_{k}").alias("hits"))
                     for k, v in names.items()])
    long = tot.select(*keys, "n", "n_pos", F.inline_outer(each)).withColumn(
        "_r", F.try_divide(F.col("hits").cast("double"), F.col("n_pos"))).withColumn("_rate", F.col("shown") / F.col("n"))
    hits, shown = F.sum("hits").cast("double"), F.sum("shown").cast("double")
    out = long.groupBy(*keys, "threshold").agg(
        (shown / F.sum("n")).alias("caption_rate"), F.try_divide(hits, F.sum("n_pos")).alias("misheard_recall"), F.try_divide(hits, shown).alias("precision"),
        F.avg("_r").alias("recall_mean_listener"), F.percentile("_r", F.lit(0.5)).alias("recall_median_listener"), F.min("_r").alias("recall_worst_listener"),
        F.coalesce(F.stddev_samp("_rate"), F.lit(0.0)).alias("caption_rate_sd_listener"), F.avg((F.col("_rate") < 0.02).cast("double")).alias("frac_listeners_near_zero_captions"))
    pr, re = F.col("precision"), F.col("misheard_recall")
    return out.withColumn("f1", F.when(pr + re > 0, 2 * pr * re / (pr + re)))


def pareto(points_: DataFrame) -> DataFrame:
    keep = ("achieved_ratio", "caption_reduction_ratio", "misheard_recall", "precision", "missed_rate", "recall_min", "recall_median", "recall_max")
    rest = [c for c in points_.columns if c not in keep and c not in ("n_words", "n_misheard", "recall_q25", "frac_near_zero")]
    return points_.select(*rest, *[F.round(c, 4).alias(c) for c in keep])


def attach_risk(tokens: DataFrame, risks: DataFrame) -> DataFrame:
    """Risks onto tokens; tokens that cannot be scored stay, at risk 0 with the reason."""
    from phonrisk.functions.hangul import has_hangul

    out = tokens.join(risks.select("listener_id", F.col("word").alias("text"), "risk"), ["listener_id", "text"], "left")
    why = F.when(~has_hangul(F.col("text")), "no Hangul").when(F.col("risk").isNull(), "no estimate")
    return out.withColumn("reason", why).withColumn("risk", F.coalesce("risk", F.lit(0.0)))


def media_summary(words: DataFrame, media: str = "media_id", risk: str = "listener_risk") -> DataFrame:
    return words.groupBy(media).agg(
        F.count("*").alias("n_words"), F.count_if(is_shown()).alias("n_shown"), F.avg(is_shown().cast("double")).alias("caption_ratio"),
        F.avg(risk).alias("mean_risk"), F.max("end_s").alias("duration_s"), F.count("confidence").alias("n_with_confidence"))


def listener_recall(selected: DataFrame, flag: Column, keys: list[str], y: str = "misheard") -> DataFrame:
    return selected.groupBy(*keys).agg(F.try_divide(F.sum(F.when(flag, F.col(y)).otherwise(0)).cast("double"), F.sum(y)).alias("recall"))


