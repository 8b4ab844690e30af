"""Studies over many cells (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonrisk.operators import confusion as cf
from phonrisk.operators import features as ft
from phonrisk.operators import metrics as mt
from phonrisk.operators import policy as po
from phonrisk.operators import splits as sp
from phonrisk.operators import trials as tr
from phonrisk.plans import runner as rn
from phonrisk.plans import studies as st
from phonrisk.session import scratch_dir, stored
from phonrisk.suite import q_confusion as qc
from phonrisk.suite import q_hearing as qh
from phonrisk.suite.q_cohort import FOLD
from phonrisk.suite.q_features import rnd
from phonrisk.suite.q_metrics import _arms, auc_sql, ARMED, DRAWN
from phonrisk.suite.q_policy import TIE
from phonrisk.suite.registry import query

SUITE = f"""(select a.seed, a.arm, a.pr_auc, a.roc_auc, b.brier from ({auc_sql('seed, arm', ARMED, 'arm_score')}) a join (select seed, arm, avg(power(arm_score-misheard,2)) brier from {ARMED} group by all) b on a.seed=b.seed and a.arm=b.arm)"""


def suite(t):
    return mt.suite(_arms(t), ["seed", "arm"], p="arm_score")


@query("x01_ablation_metrics", f"select seed, arm, round(pr_auc,6) pr_auc, round(roc_auc,6) roc_auc, round(brier,6) brier from {SUITE}")
def _(t):
    return rnd(suite(t).select("seed", "arm", "pr_auc", "roc_auc", "brier"))


# ---- the study runner: models without a fit are checked in SQL, through folds, stored cells and results

ROWS = "(select t.* from word_trials t join cal_listeners c on c.listener_id=t.listener_id)"
SFOLD = f"""(select seed, listener_id, (case when (rn-1)//5%2=0 then (rn-1)%5 else 4-(rn-1)%5 end)::int fold from (select seed, listener_id,
  row_number() over (partition by seed order by round(avg(misheard),9), cast(concat('0x',substr(md5(concat('fold',seed::varchar,':',listener_id::varchar)),1,8)) as bigint), listener_id) rn from {ROWS} r group by seed, listener_id))"""
SCELL = f"""(select seed, fold, n_test, sum(n_test) over (partition by seed)-n_test n_train, (sum(pos) over (partition by seed)-pos)::double/(sum(n_test) over (partition by seed)-n_test) rate
  from (select r.seed, f.fold, count(*) n_test, sum(misheard) pos from {ROWS} r join {SFOLD} f on f.seed=r.seed and f.listener_id=r.listener_id group by all))"""
SPRED = f"""(select r.seed, r.listener_id, r.misheard, m.model, case when m.model='prevalence' then c.rate else round(least(greatest(x.x_r_phon,0),1),9) end p
  from {ROWS} r join {SFOLD} f on f.seed=r.seed and f.listener_id=r.listener_id join {SCELL} c on c.seed=f.seed and c.fold=f.fold join xblock x on x.listener_id=r.listener_id and x.word=r.word
  cross join (values ('prevalence'),('phoneme_independence')) m(model))"""


def study(t, arms=("confusion_only",), models=(rn.INDEPENDENCE, rn.PREVALENCE), **kw):
    heard = any({"pta", "clinical"} & set(ft.ARMS[a]) for a in arms)
    hearing = stored(qh.summary(t), "hearing") if heard else None
    return rn.Runner(t.spark, scratch_dir(t.spark, "study"), rn.Study(arms, models, **kw), t.word_trials, hearing=hearing, est=stored(qc.profiles(t), "profiles"))


@query("x01_study_folds", f"select seed, listener_id, fold from {SFOLD}")
def _(t):
    return study(t).folds()


@query("x01_study_cells", f"select m.model, c.seed, c.fold, c.n_train, c.n_test from {SCELL} c cross join (values ('prevalence'),('phoneme_independence')) m(model)")
def _(t):
    return study(t).run().done().select("model", "seed", "fold", "n_train", "n_test")


@query("x01_study_metrics", f"""select a.seed, a.model, round(pr_auc,6) pr_auc, round(roc_auc,6) roc_auc, round(brier,6) brier, n, n_listeners, round(q,6) floor_pr_auc, round(q*(1-q),6) floor_brier, 5::bigint n_folds
  from ({auc_sql('seed, model', SPRED, 'p')}) a join (select seed, model, avg(power(p-misheard,2)) brier, count(*) n, count(distinct listener_id) n_listeners, avg(misheard) q from {SPRED} group by all) b on a.seed=b.seed and a.model=b.model""")
def _(t):
    return rnd(study(t).run().metrics().select("seed", "model", "pr_auc", "roc_auc", "brier", "n", "n_listeners", "floor_pr_auc", "floor_brier", "n_folds"))


SPER = f"(select seed, listener_id, p s, sum(misheard) pos, sum(1-misheard) neg from {SPRED} where model='MODEL' group by all)"
SDRAWN = DRAWN.replace("from word_trials", f"from {ROWS}")
SBOOT = f"""(select seed, b, sum(pos/tp*(tp-cp+pos)/(tp+tn-cn+pos+neg)) pr_auc from (select *, sum(pos+neg) over (partition by seed, b order by s) cn, sum(pos) over (partition by seed, b order by s) cp,
   sum(pos) over (partition by seed, b)::double tp, sum(neg) over (partition by seed, b)::double tn from (select seed, b, s, sum(w*pos) pos, sum(w*neg) neg from ({SDRAWN}) d join {SPER} p on p.listener_id=d.listener_id group by all)) group by all)"""


@query("x01_study_contrasts", f"""select p.seed, 'phoneme_independence' model, 'prevalence' reference, round(point,6) point, round(lo,6) lo, round(hi,6) hi, n_valid, lo>0 or hi<0 excludes_zero
  from (select seed, max(case when model='phoneme_independence' then pr_auc end)-max(case when model='prevalence' then pr_auc end) point from ({auc_sql('seed, model', SPRED, 'p')}) group by seed) p
  join (select x.seed, quantile_cont(x.pr_auc-y.pr_auc,0.025) lo, quantile_cont(x.pr_auc-y.pr_auc,0.975) hi, count(x.pr_auc-y.pr_auc) n_valid
        from {SBOOT.replace('MODEL', 'phoneme_independence')} x join {SBOOT.replace('MODEL', 'prevalence')} y on x.seed=y.seed and x.b=y.b group by x.seed) i on p.seed=i.seed""")
def _(t):
    out = study(t).run().contrasts(((rn.INDEPENDENCE, rn.PREVALENCE),), between="model")
    return rnd(out.select("seed", "model", "reference", "point", "lo", "hi", "n_valid", "excludes_zero"))


@query("x01_ablation_study")
def _(t):
    arms = ("word_context_only", "pta_only", "clinical", "confusion_only", "clinical_plus_confusion")
    return rnd(study(t, arms, ("logistic", rn.INDEPENDENCE)).run().summary())


UNP = f"(select arm, 'pr_auc' metric, pr_auc v from {SUITE} union all select arm, 'brier', brier from {SUITE})"


@query("x02_summary_across_seeds", f"select arm, metric, round(avg(v),6) mean, round(stddev_samp(v),6) sd, round(min(v),6) min, round(max(v),6) max, count(*) n from {UNP} group by all")
def _(t):
    return rnd(st.summarise(suite(t), ["arm"], ["pr_auc", "brier"]))


@query("x02_best_arm", f"select arg_max(arm, m) best_arm, round(max(m),6) best_mean from (select arm, avg(pr_auc) m from {SUITE} group by all)")
def _(t):
    return rnd(st.best_arm(suite(t), "arm", "pr_auc"))


def sel(score, keys="seed, listener_id"):
    return f"(select *, row_number() over (partition by {keys} order by {score} desc, {TIE}, row_id) rn, count(*) over (partition by {keys}) nn from word_trials)"


def rec(score, b="0.2::double"):
    return f"select seed, sum(case when rn<=round_even({b}*nn,0) then misheard else 0 end)::double/sum(misheard) r from {sel(score)} group by seed"


GAIN = f"(select 'fine' as model, a.seed, a.r-z.r gain, a.r from ({rec('score')}) a join ({rec('length(word)')}) z on a.seed=z.seed union all select 'noise', a.seed, a.r-z.r, a.r from ({rec('score_b')}) a join ({rec('length(word)')}) z on a.seed=z.seed)"


def gains(t):
    parts = []
    base = po.frontier(t.word_trials.withColumn("_len", F.char_length("word").cast("double")), ["seed"], budgets=(0.2,), score="_len").select(
        "seed", F.col("misheard_recall").alias("_base"))
    for name, score in (("fine", "score"), ("noise", "score_b")):
        f = po.frontier(t.word_trials, ["seed"], budgets=(0.2,), score=score).select("seed", F.col("misheard_recall").alias("r"))
        parts.append(f.join(base, "seed").select(F.lit(name).alias("model"), "seed", (F.col("r") - F.col("_base")).alias("gain"), "r"))
    return parts[0].unionByName(parts[1])


@query("x03_model_verdicts", f"select model, count(*) n_seeds, count(*) filter (where gain>0) n_seeds_beating, round(avg(gain),6) mean_gain, count(*)=count(*) filter (where gain>0) beats_every_seed from {GAIN} group by all")
def _(t):
    return rnd(st.every_seed_winners(gains(t), ["model"], "gain"))


@query("x03_paired_verdict", f"select count(*) n_seeds, round(avg(d),6) mean, round(stddev_samp(d),6) sd, count(*) filter (where d>0) n_positive from (select seed, max(case when model='fine' then r end)-max(case when model='noise' then r end) d from {GAIN} group by seed)")
def _(t):
    return rnd(st.paired(gains(t), "model", "fine", "noise", "r"))


LENGTHS = (10, 25, 50, 100, 200, 400)
EVID = """(select b.n calibration_length, o.listener_id, o.target, o.perceived from obs o join (select trial_id, row_number() over (partition by listener_id order by trial_id) rn from calib_trials) r on r.trial_id=o.trial_id join (values (10),(25),(50),(100),(200),(400)) b(n) on r.rn<=b.n)"""


def evidence_lengths(t):
    first = st.take_first_trials(t.calib_trials, LENGTHS)
    obs = tr.observations(tr.score_trials(first), "listener_id", "calibration_length")
    return cf.count_observations(obs, ["listener_id", "calibration_length"])


@query("x04_evidence_length_grid", f"select calibration_length, count(*) n_listeners, round(avg(a),6) mean_accuracy from (select calibration_length, listener_id, avg(case when target=perceived then 1.0 else 0 end) a from {EVID} group by all) group by all")
def _(t):
    acc = cf.accuracy(evidence_lengths(t), ["listener_id", "calibration_length"])
    return rnd(acc.groupBy("calibration_length").agg(F.count("*").alias("n_listeners"), F.avg("accuracy").alias("mean_accuracy")))


GROUPS = """(select h.listener_id, coalesce(severity_who,'unknown') severity, case when mean_wrs is null then 'unknown' when mean_wrs<60 then 'wrs_low' when mean_wrs<80 then 'wrs_mid' else 'wrs_high' end wrs_band,
  case when u is null then 'unknown' when u<0.95 then 'usable_low' when u<0.99 then 'usable_mid' else 'usable_high' end evidence_band, case when a is null then 'unknown' when a<0.55 then 'acc_low' when a<0.8 then 'acc_mid' else 'acc_high' end idiosyncrasy_band
  from hear h full join (select listener_id, 1-count(*) filter (where rs is null)/count(*)::double u from scored group by all) s on s.listener_id=h.listener_id full join (select listener_id, avg(case when target=perceived then 1.0 else 0 end) a from obs group by all) o on o.listener_id=h.listener_id)"""


def groups(t):
    return st.listener_subgroups(qh.summary(t), cf.profile_stats(qc.scored(t), ["listener_id"]), cf.accuracy(qc.counts(t), ["listener_id"]))


BANDS = ["severity", "wrs_band", "evidence_band", "idiosyncrasy_band"]
SLICED = f"(select w.*, {', '.join('g.' + b for b in BANDS)} from word_trials w join {GROUPS} g on g.listener_id=w.listener_id)"
AXES = ["snr_db", "speaker", *BANDS]
AXIS_SQL = [("overall", "'all'"), *((a, f"{a}::varchar") for a in AXES)]


def grouped(t):
    return t.word_trials.join(groups(t).select("listener_id", *BANDS), "listener_id")


@query("x05_slice_metrics", " union all ".join(
    f"select '{a}' slice_axis, {v} slice_value, count(*) n_rows, round(avg(misheard),6) prevalence, round(avg(power(score-misheard,2)),6) brier from {SLICED} group by all"
    for a, v in AXIS_SQL))
def _(t):
    return rnd(st.additive_slices(grouped(t), AXES))


LONG = "(" + " union all ".join(f"select '{a}' slice_axis, {v} slice_value, * from {SLICED}" for a, v in AXIS_SQL) + ")"


@query("x05_slice_rank_metrics", f"select slice_axis, slice_value, round(pr_auc,6) pr_auc, round(roc_auc,6) roc_auc from ({auc_sql('slice_axis, slice_value', LONG)})")
def _(t):
    return rnd(st.slice_rank_metrics(grouped(t), AXES).select("slice_axis", "slice_value", "pr_auc", "roc_auc"))


@query("x06_listener_subgroups", f"select * from {GROUPS}")
def _(t):
    return groups(t)


K = "slice_axis, slice_value"


def lsel(score):
    return f"(select *, row_number() over (partition by {K}, listener_id order by {score} desc, {TIE}, row_id) rn, count(*) over (partition by {K}, listener_id) nn from {LONG})"


def lrec(score, out):
    return f"select {K}, budget, sum(h)/sum(np) {out}, quantile_cont(h/nullif(np,0),0.5) recall_median, min(h/nullif(np,0)) recall_worst, quantile_cont(h/nullif(np,0),0.25) recall_q25, avg(case when np=0 then null when h/np<0.05 then 1.0 else 0 end) frac_near_zero from (select {K}, listener_id, budget, sum(case when rn<=round_even(budget*nn,0) then misheard else 0 end)::double h, sum(misheard)::double np from {lsel(score)} cross join (values (0.1::double),(0.2::double),(0.3::double),(0.4::double),(0.5::double)) b(budget) group by all) group by all"


SR = f"(select a.*, z.wl word_length_recall, a.recall-z.wl gain from ({lrec('score', 'recall')}) a join (select {K}, budget, wl from ({lrec('length(word)', 'wl')})) z on z.slice_axis=a.slice_axis and z.slice_value=a.slice_value and z.budget=a.budget)"


def battery(t):
    return st.slice_recall(grouped(t), AXES, po.BUDGETS, listener_axes=BANDS)


@query("x07_slice_recall", "select slice_axis, slice_value, budget, " + ", ".join(f"round({c},6) {c}" for c in ("recall", "recall_median", "recall_worst", "recall_q25", "frac_near_zero", "word_length_recall", "gain")) + f" from {SR}")
def _(t):
    return rnd(battery(t), "budget")


@query("x08_condition_gain", f"select a.budget, round(a.gain,6) gain_overall, round(m,6) gain_within_condition_mean, round(mn,6) gain_within_condition_min from {SR} a join (select budget, avg(gain) m, min(gain) mn from {SR} where slice_axis='snr_db' group by all) b on a.budget=b.budget where a.slice_axis='overall'")
def _(t):
    return rnd(st.condition_gain(battery(t)), "budget")


@query("x09_budget_monotonicity", f"select slice_axis, slice_value, bool_and(coalesce(gain>=p-1e-12,true)) is_monotone_increasing from (select *, lag(gain) over (partition by slice_axis, slice_value order by budget) p from {SR}) group by all")
def _(t):
    return st.monotone(battery(t), ["slice_axis", "slice_value"])


@query("x10_smallest_length", f"select min(calibration_length) min_calibration_length from (select calibration_length from (select calibration_length, listener_id%5 seed, avg(case when target=perceived then 1.0 else 0 end)-0.5 gain from {EVID} group by all) group by all having count(*)=count(*) filter (where gain>0))")
def _(t):
    c = evidence_lengths(t).withColumn("seed", F.col("listener_id") % 5)
    g = cf.accuracy(c, ["calibration_length", "seed"]).withColumn("gain", F.col("accuracy") - 0.5)
    return st.smallest_winning_length(g)


@query("x11_grid_completeness", "select a.seed, b.arm from (select distinct seed from word_trials) a cross join (values ('fine'),('coarse'),('absent')) b(arm) except select distinct seed, arm from " + ARMED)
def _(t):
    return st.missing_cells(_arms(t).select("seed", "arm").distinct(), {"seed": [1, 2, 3, 4, 5], "arm": ["fine", "coarse", "absent"]})


TRAIN = f"(select w.*, f.fold from word_trials w join {FOLD} f on f.listener_id=w.listener_id)"
TAUS = f"""(select fold, tau, coalesce(least(1.0::double, greatest(0.0::double, 0.2::double-avg(case when score>tau then 1.0::double else 0 end))/nullif(avg(case when abs(score-tau)<=1e-12 then 1.0::double else 0 end),0)),0) f
  from (select k.fold, t.score, quantile_cont(t.score,0.8) over (partition by k.fold) tau from {TRAIN} t join (values (0),(1),(2),(3),(4)) k(fold) on t.fold<>k.fold) group by fold, tau)"""
MATCH = f"""(select w.*, case when abs(w.score-r.tau)<=1e-12 then cast(concat('0x',substr(md5(concat('tie:',w.listener_id::varchar,':',w.word)),1,8)) as bigint)/4294967296.0::double < r.f else w.score>r.tau end chosen
  from {TRAIN} w join {TAUS} r on r.fold=w.fold)"""


@query("x12_matched_rate", f"select round(avg(case when chosen then 1.0 else 0 end),6) achieved_caption_rate, round(sum(case when chosen then misheard else 0 end)::double/sum(misheard),6) misheard_recall, abs(avg(case when chosen then 1.0::double else 0 end)-0.2)<=0.02 within_tolerance from {MATCH}")
def _(t):
    # Every fold's threshold comes from its training listeners and is applied to the held-out ones.
    folds = sp.listener_folds(t.word_trials, 5)
    tau = po.fold_thresholds(t.word_trials, folds, 0.2)
    rows = t.word_trials.join(folds, "listener_id").join(F.broadcast(tau), "fold").withColumn("chosen", po.passes("score", "listener_id", "word"))  # one row a fold
    rate = F.avg(F.col("chosen").cast("double"))
    return rnd(rows.agg(
        rate.alias("achieved_caption_rate"), F.try_divide(F.sum(F.when(F.col("chosen"), F.col("misheard")).otherwise(0)).cast("double"), F.sum("misheard")).alias("misheard_recall"),
        (F.abs(rate - 0.2) <= 0.02).alias("within_tolerance")))


@query("x13_report_table", f"select arm, metric, round(avg(v)+1e-10::double,4) mean, round(stddev_samp(v)+1e-10::double,4) sd, count(*) n from {UNP} group by all")
def _(t):
    rows = st.summarise(suite(t), ["arm"], ["pr_auc", "brier"]).select("arm", "metric", (F.col("mean") + 1e-10).alias("mean"), (F.col("sd") + 1e-10).alias("sd"), "n")
    return st.rounded(rows, {"mean": 4, "sd": 4}, [F.col("mean").desc()])


@query("x14_current_runs", "select run_id, entry_id, status from (select *, row_number() over (partition by run_id order by logged_at desc, entry_id desc) rn from run_log) where rn=1")
def _(t):
    return st.current_runs(t.run_log).select("run_id", "entry_id", "status")


@query("x14_run_collisions", "select run_id, count(distinct started_at) n_starts from run_log group by all having count(distinct started_at)>1")
def _(t):
    return st.run_collisions(t.run_log)


@query("x14_latest_completed", "select name, run_id from (select *, row_number() over (partition by name order by started_at desc, run_id collate \"binary\" desc) k from (select *, row_number() over (partition by run_id order by logged_at desc, entry_id desc) rn from run_log) where rn=1 and status='completed') where k=1")
def _(t):
    return st.latest_completed(t.run_log)


RK = "row_number() over (partition by listener_id order by {s} desc, row_id)"


@query("x15_complementarity", f"""select (select round(corr(misheard-score, misheard-score_b),6) from word_trials) residual_correlation, round(quantile_cont(rho,0.5),6) median_rank_correlation, round(sum(bo)::double/sum(na),6) top_overlap, sum(won)-sum(lost) net_recovered from (
  select listener_id, corr(ra,rb) rho, count(*) filter (where ra<=c and rb<=c) bo, count(*) filter (where ra<=c) na, sum(case when rb<=c and ra>c then misheard else 0 end) won, sum(case when ra<=c and rb>c then misheard else 0 end) lost
  from (select *, {RK.format(s='score')} ra, {RK.format(s='score_b')} rb, round_even(0.2::double*count(*) over (partition by listener_id),0) c from word_trials) group by all)""")
def _(t):
    return rnd(st.complementarity(t.word_trials, "score", "score_b"))
