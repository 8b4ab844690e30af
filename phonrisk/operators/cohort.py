"""Cohort statistics and outcome diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonrisk.operators import metrics as mt
from phonrisk.operators.lexicon import known_forms


def mishear_rate(trials: DataFrame, keys: list[str]) -> DataFrame:
    return trials.groupBy(*keys).agg(F.count("*").alias("n_trials"), F.count_distinct("listener_id").alias("n_listeners"),
                                     F.avg("misheard").alias("mishear_rate"))


def by_stratum(trials: DataFrame, strata: DataFrame, listener: str = "listener_id") -> DataFrame:
    """``strata`` is (listener, stratum). Trials are summed per listener before the join."""
    per = trials.groupBy(listener).agg(F.sum("misheard").alias("_pos"), F.count("*").alias("_n"))
    return per.join(strata, listener).groupBy("stratum").agg(
        F.count("*").alias("n_listeners"), (F.sum("_pos") / F.sum("_n")).alias("mishear_rate"))


def syllable_accuracy(scored: DataFrame, strata: DataFrame, listener: str = "listener_id") -> DataFrame:
    per = scored.groupBy(listener).agg(F.avg((F.col("trial_error") == "correct").cast("double")).alias("_a"))
    return per.join(strata, listener).groupBy("stratum").agg(F.avg("_a").alias("accuracy"))


def lexical_trap_rate(trials: DataFrame, lexicon: DataFrame) -> DataFrame:
    errored = known_forms(trials.where("n_segment_errors > 0"), lexicon)
    return errored.agg(F.count("*").alias("n_errored"), F.avg(F.col("is_word").cast("double")).alias("lexical_trap_rate"))


def summary(trials: DataFrame, lexicon: DataFrame) -> DataFrame:
    base = trials.agg(F.count("*").alias("n_word_trials"), F.count_distinct("listener_id").alias("n_listeners"), F.avg("misheard").alias("mishear_rate"))
    return base.join(F.broadcast(lexical_trap_rate(trials, lexicon)))  # one row


def signal_ceiling(trials: DataFrame) -> DataFrame:
    """Average precision of the best predictor that sees only (errors, syllables), beside word length."""
    cells = trials.groupBy("n_segment_errors", "n_syll").agg(F.count("*").alias("n"), F.sum("misheard").alias("pos"))
    oracle = cells.withColumn("p", F.col("pos") / F.col("n")).groupBy("p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    length = cells.groupBy(F.col("n_syll").cast("double").alias("p")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    zero = F.try_divide(F.sum(F.when(F.col("n_segment_errors") == 0, F.col("pos"))).cast("double"), F.sum(F.when(F.col("n_segment_errors") == 0, F.col("n"))))
    out = cells.agg(F.sum("n").alias("n_trials"), (F.sum("pos") / F.sum("n")).alias("prevalence"), F.count("*").alias("n_cells"),
                    zero.alias("p_misheard_given_zero_errors"))
    for name, c in (("oracle_pr_auc", oracle), ("word_length_pr_auc", length)):
        out = out.join(F.broadcast(mt.rank_metrics(c, [], bounded=True).select(F.col("pr_auc").alias(name))))  # one row; a few dozen cells
    return out


def form_influence(trials: DataFrame, min_count: int = 5) -> DataFrame:
    """Spread of mishear rates across heard forms inside (errors, syllables) cells."""
    cell = ["n_segment_errors", "n_syll"]
    forms = (trials.where(F.col("perceived_word").isNotNull() & (F.col("perceived_word") != ""))
             .groupBy(*cell, "perceived_word").agg(F.avg("misheard").alias("rate"), F.count("*").alias("n")).where(F.col("n") >= min_count))
    cells = forms.groupBy(*cell).agg(F.stddev_pop("rate").alias("sd"), F.count("*").alias("n_forms")).where("n_forms >= 2")
    return cells.agg(F.count("*").alias("n_cells_with_comparable_forms"), F.avg("sd").alias("mean_rate_sd_across_forms"),
                     F.max("sd").alias("max_rate_sd_across_forms"))
