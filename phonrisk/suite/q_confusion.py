"""Calibration scoring (C) and confusion aggregation (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonrisk.operators import confusion as cf
from phonrisk.operators import dims, trials
from phonrisk.operators import features as ft
from phonrisk.suite.registry import query, r6

L = ["listener_id"]


def scored(t):
    return trials.score_trials(t.calib_trials)


def obs(t, *extra):
    return trials.observations(scored(t), "listener_id", *extra)


def counts(t):
    return cf.count_observations(obs(t), L)


def rows(t):
    return cf.target_rows(counts(t), L)


def estimated(t):
    return cf.with_probabilities(rows(t))


def profiles(t):
    return ft.profiles(counts(t), L)


@query("c01_score_trials", "select trial_id, position, target, perceived, error_type from obs")
def _(t):
    return trials.observations(scored(t), "trial_id")


@query("c02_response_quality", "select listener_id, quality, count(*) n from scored group by all")
def _(t):
    return scored(t).groupBy("listener_id", "quality").agg(F.count("*").alias("n"))


@query("c03_position_errors", "select position, error_type, count(*) n from obs group by all")
def _(t):
    return obs(t).groupBy("position", "error_type").agg(F.count("*").alias("n"))


@query("c04_trial_errors", "select trial_id, trial_error from trial_err")
def _(t):
    return scored(t).select("trial_id", "trial_error")


@query("c05_merge_trials", "select listener_id, position, target, perceived, n from counts")
def _(t):
    early, late = (t.calib_trials.where(F.col("condition") == c) for c in ("quiet", "noise"))
    merged = trials.merge_trials(early, late)
    return cf.count_observations(trials.observations(trials.score_trials(merged), "listener_id"), L)


@query("c06_by_condition", "select listener_id, condition, position, target, perceived, count(*) n from obs group by all")
def _(t):
    return cf.count_observations(obs(t, "condition"), ["listener_id", "condition"])


ERRS = ["correct", "onset_error", "nucleus_error", "coda_error", "compound", "no_response"]


@query("c07_error_distribution", "select listener_id, " + ", ".join(f"count(*) filter (where trial_error='{e}') as {e}" for e in ERRS) + " from trial_err group by all")
def _(t):
    return trials.error_distribution(scored(t), L)


@query("d01_confusion_counts", "select * from counts")
def _(t):
    return counts(t)


@query("d01_weighted_counts", "select listener_id, position, target, perceived, sum(case when condition='noise' then 2 else 1 end) n from obs group by all")
def _(t):
    weighted = obs(t, "condition").withColumn("w", F.when(F.col("condition") == "noise", 2).otherwise(1))
    return cf.count_observations(weighted, L, "w")


@query("d02_dense_counts", "select listener_id, position, target, perceived, n from dense")
def _(t):
    return cf.dense(rows(t), L).select("listener_id", "position", "target", "perceived", "n")


@query("d03_row_totals", "select listener_id, position, target, big_n from diag")
def _(t):
    return rows(t).select("listener_id", "position", "target", "big_n")


@query("d04_unobserved_targets", "select listener_id, position, count(*) filter (where big_n>0) n_observed, count(*) filter (where big_n=0) n_unobserved from diag group by all")
def _(t):
    return rows(t).groupBy("listener_id", "position").agg(
        F.count_if(F.col("big_n") > 0).alias("n_observed"), F.count_if(F.col("big_n") == 0).alias("n_unobserved"))


@query("d05_posterior_mean", "select listener_id, position, target, perceived, round(p,6) p from post")
def _(t):
    return cf.posterior(estimated(t), L).select("listener_id", "position", "target", "perceived", r6("p").alias("p"))


SKEWED = "(case when d.target=d.perceived then 0.5 else 0.5/(d.k-1) end)"


@query("d06_explicit_prior", f"select listener_id, position, target, round((n+2.0::double*{SKEWED})/(big_n+2),6) p_correct from dense d where target=perceived")
def _(t):
    d = dims.dim_target(t.spark)
    prior = d.select("position", F.col("symbol").alias("target"), F.transform(
        F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.when(i == F.col("idx"), 0.5).otherwise(0.5 / (F.col("k") - 1))).alias("prior"))
    if not cf.bad_priors(prior).isEmpty():
        raise ValueError("prior rows must be distributions")
    est = cf.with_probabilities(rows(t), alpha=2.0, prior=prior)
    return cf.diagonal(est, L).select("listener_id", "position", "target", r6("p_correct").alias("p_correct"))


@query("d07_empty_row_guard", "select listener_id, count(*) n_undefined from diag where big_n=0 group by all")
def _(t):
    return cf.undefined_rows(rows(t)).groupBy("listener_id").agg(F.count("*").alias("n_undefined"))


@query("d08_empirical", "select listener_id, position, target, perceived, round(n::double/big_n,6) p from dense where n>0")
def _(t):
    return cf.empirical(counts(t), L).select("listener_id", "position", "target", "perceived", r6("p").alias("p"))


@query("d09_p_correct", "select listener_id, position, target, round(p,6) p_correct, round(1-p,6) confusability from diag")
def _(t):
    return cf.diagonal(estimated(t), L).select("listener_id", "position", "target", r6("p_correct").alias("p_correct"),
                                               r6("confusability").alias("confusability"))


@query("d10_row_entropy", "select listener_id, position, target, round(h,6) entropy from entropy")
def _(t):
    return cf.diagonal(estimated(t), L).select("listener_id", "position", "target", r6("entropy").alias("entropy"))


@query("d11_top_confusions", """select listener_id, position, target, perceived, n, round(p,6) p, rank from (select *,
  row_number() over (partition by listener_id, position, target order by p desc, p_idx) rank from post where target<>perceived) where rank<=3""")
def _(t):
    return cf.top_confusions(estimated(t), L, 3).withColumn("p", r6("p"))


@query("d12_pooled_counts", "select position, target, perceived, sum(n) n, (select count(distinct listener_id) from counts) n_contributors from counts group by all")
def _(t):
    c = counts(t)
    who = cf.prior_contributors(c).agg(F.count("*").alias("n_contributors"))
    return cf.pool(c).join(F.broadcast(who))  # one row


@query("d13_coverage", "select listener_id, position, round(count(*) filter (where big_n>0)::double/count(*),6) coverage from diag group by all")
def _(t):
    return cf.totals(rows(t), L).select("listener_id", "position", r6("coverage").alias("coverage"))


@query("d14_accuracy", "select listener_id, round(avg(case when target=perceived then 1.0 else 0 end),6) accuracy, round(1-avg(case when target=perceived then 1.0 else 0 end),6) global_error from obs group by all")
def _(t):
    return cf.accuracy(counts(t), L).select("listener_id", r6("accuracy").alias("accuracy"), r6("global_error").alias("global_error"))


@query("d15_profile_stats", "select listener_id, count(*) n_trials, count(*) filter (where rs is null) n_unusable from scored group by all")
def _(t):
    return cf.profile_stats(scored(t), L)


@query("d16_group_prior", "select position, target, perceived, round(p,6) p from group_prior")
def _(t):
    est = cf.with_probabilities(cf.target_rows(cf.pool(counts(t)), []))
    return cf.posterior(est, []).select("position", "target", "perceived", r6("p").alias("p"))


@query("d17_shrunk_profiles", "select listener_id, position, target, round(ps,6) p_correct from shrunk where target=perceived")
def _(t):
    c = counts(t)
    est = cf.shrink(cf.target_rows(c, L), cf.group_prior(c))
    return cf.diagonal(est, L).select("listener_id", "position", "target", r6("p_correct").alias("p_correct"))


@query("d18_shrinkage_report", """select s.listener_id, s.position, round(avg(case when s.big_n=0 then abs(s.ps-p.p) end),6) mean_move_unobserved,
  round(avg(case when s.big_n>=10 then abs(s.ps-p.p) end),6) mean_move_well_observed
  from shrunk s join diag p on p.listener_id=s.listener_id and p.position=s.position and p.target=s.target where s.target=s.perceived group by all""")
def _(t):
    c = counts(t)
    return cf.shrinkage_report(cf.target_rows(c, L), cf.group_prior(c), L).withColumns({
        "mean_move_unobserved": r6("mean_move_unobserved"), "mean_move_well_observed": r6("mean_move_well_observed")})


@query("d19_resmooth", "select listener_id, position, target, round((n+4.0::double/k)/(big_n+4),6) p_correct from dense where target=perceived")
def _(t):
    est = cf.with_probabilities(rows(t), alpha=4.0)
    return cf.diagonal(est, L).select("listener_id", "position", "target", r6("p_correct").alias("p_correct"))


@query("d20_matrix_layout", "select listener_id, position, target, " + ", ".join(f"sum(case when p_idx={i} then n end) p{i:02d}" for i in range(29)) +
       " from dense d where big_n>0 group by all")
def _(t):
    """The three matrices, one below the other; columns that a position's alphabet lacks are null."""
    c = counts(t)
    parts = [cf.layout(c, L, p).withColumn("position", F.lit(p)) for p in ("coda", "nucleus", "onset")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query("d21_profile_digest", "select listener_id, substr(sha256(string_agg(concat_ws('|',position,target,perceived,cast(n as varchar)), ';' order by concat_ws('|',position,target,perceived,cast(n as varchar)) collate \"binary\")),1,16) digest from counts group by all")
def _(t):
    return cf.profile_digest(counts(t), L)
