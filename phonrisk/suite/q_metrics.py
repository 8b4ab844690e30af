"""Metrics and uncertainty (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonrisk.operators import metrics as mt
from phonrisk.plans import studies as st
from phonrisk.session import durable
from phonrisk.suite.q_features import rnd
from phonrisk.suite.registry import query

S = ["seed"]


def counts(t, keys=S, p="score"):
    return mt.score_counts(t.word_trials, keys, p=p)


BASE = "count(*) n, sum(misheard) n_pos, sum(case when score>=0.5 then misheard else 0 end) tp, sum(case when score>=0.5 then 1-misheard else 0 end) fp, sum(case when score<0.5 then 1-misheard else 0 end) tn, sum(case when score<0.5 then misheard else 0 end) fn"


@query("m01_threshold_metrics", f"""select *, round(tp::double/n_pos,6) recall, round(tp::double/(tp+fp),6) as precision, round(tn::double/(tn+fp),6) specificity,
  round(2.0::double*tp/(2*tp+fp+fn),6) f1, round((tp+tn)::double/n,6) accuracy from (select seed, {BASE} from word_trials group by all)""")
def _(t):
    return rnd(mt.threshold_metrics(counts(t), S))


@query("m02_brier", "select seed, round(avg(power(score-misheard,2)),6) brier from word_trials group by all")
def _(t):
    return rnd(mt.probability_metrics(counts(t), S).select("seed", "brier"))


PC = "least(greatest(score_b,1e-6::double),1-1e-6::double)"


@query("m03_log_loss", f"select seed, round(-avg(misheard*ln({PC})+(1-misheard)*ln(1-{PC})),6) log_loss from word_trials group by all")
def _(t):
    return rnd(mt.probability_metrics(counts(t, p="score_b"), S, clip=1e-6).select("seed", "log_loss"))


def auc_sql(keys, src="word_trials", score="score"):
    return f"""select {keys}, (sum(pos*(cn-cp-neg+neg/2.0::double)))/(max(tp)*max(tn)) roc_auc, sum(pos/tp*(tp-cp+pos)/(tp+tn-cn+pos+neg)) pr_auc from (select *, sum(pos+neg) over (partition by {keys} order by s) cn,
  sum(pos) over (partition by {keys} order by s) cp, sum(pos) over (partition by {keys})::double tp, sum(neg) over (partition by {keys})::double tn
  from (select {keys}, {score} s, sum(misheard) pos, sum(1-misheard) neg from {src} group by all)) group by {keys}"""


@query("m04_roc_auc", f"select seed, round(roc_auc,6) roc_auc from ({auc_sql('seed')})")
def _(t):
    return rnd(mt.rank_metrics(counts(t), S).select("seed", "roc_auc"))


@query("m05_average_precision", f"select seed, round(pr_auc,6) pr_auc from ({auc_sql('seed', score='score_b')})")
def _(t):
    return rnd(mt.rank_metrics(counts(t, p="score_b"), S).select("seed", "pr_auc"))


BIN = "len(list_filter([0.1::double,0.2::double,0.3::double,0.4::double,0.5::double,0.6::double,0.7::double,0.8::double,0.9::double], lambda e: e < score))"
REL = f"select seed, {BIN} bin, count(*) n, avg(score) mean_p, avg(misheard) rate from word_trials group by all"


@query("m06_ece", f"select seed, round(sum(n*abs(mean_p-rate))/sum(n),6) ece from ({REL}) group by all")
def _(t):
    return rnd(mt.calibration(counts(t), S).select("seed", "ece"))


@query("m07_mce", f"select seed, round(max(abs(mean_p-rate)),6) mce from ({REL}) group by all")
def _(t):
    return rnd(mt.calibration(counts(t), S).select("seed", "mce"))


@query("m08_reliability", f"select seed, bin, n, round(mean_p,6) mean_p, round(rate,6) rate from ({REL})")
def _(t):
    return rnd(mt.reliability(counts(t), S))


@query("m09_prevalence_floor", "select seed, round(q,6) prevalence, round(q*(1-q),6) brier, round(q,6) pr_auc, round(0.5::double,6) roc_auc, round(0.0::double,6) ece from (select seed, avg(misheard) q from word_trials group by all)")
def _(t):
    return rnd(mt.prevalence_floor(t.word_trials, S).select("seed", "prevalence", "brier", "pr_auc", "roc_auc", "ece"))


@query("m10_metrics_by_keys", f"""select a.seed, a.speaker, round(roc_auc,6) roc_auc, round(pr_auc,6) pr_auc, round(b.brier,6) brier, round(b.accuracy,6) accuracy from ({auc_sql('seed, speaker')}) a
  join (select seed, speaker, avg(power(score-misheard,2)) brier, avg(case when (score>=0.5)=(misheard=1) then 1.0 else 0 end) accuracy from word_trials group by all) b on a.seed=b.seed and a.speaker=b.speaker""")
def _(t):
    s = mt.suite(t.word_trials, ["seed", "speaker"])
    return rnd(s.select("seed", "speaker", "roc_auc", "pr_auc", "brier", "accuracy"))


RN = "row_number() over (partition by seed, listener_id order by score desc, row_id)"


@query("m11_ndcg", f"""select seed, round(avg(d/i),6) ndcg_mean, count(*) n_listeners_scored from (select seed, listener_id, sum(misheard/log2(rn+1)) d, sum(case when misheard=1 then 1/log2(k+1) end) i
  from (select *, {RN} rn, row_number() over (partition by seed, listener_id, misheard order by score desc, row_id) k from word_trials) group by all having sum(misheard)>0) group by all""")
def _(t):
    return rnd(mt.listener_ranking(t.word_trials, S).select("seed", "ndcg_mean", "n_listeners_scored"))


@query("m12_map", f"select seed, round(avg(pr_auc),6) map_mean from ({auc_sql('seed, listener_id')}) where isfinite(pr_auc) group by all".replace("(sum(pos*(cn-cp-neg+neg/2.0::double)))/(max(tp)*max(tn))", "null::double"))
def _(t):
    return rnd(mt.listener_ranking(t.word_trials, S).select("seed", "map_mean"))


B = 1_000  # as the reference's DEFAULT_N_BOOTSTRAP
DRAWN = f"""select b, w.listener_id, count(*) w from (select b.range b, 1 + cast(concat('0x',substr(md5(concat('boot0:',b.range::varchar,':',d.range::varchar)),1,15)) as bigint) % (select count(distinct listener_id) from word_trials) i
  from range({B}) b cross join range((select count(distinct listener_id) from word_trials)) d) x join (select listener_id, row_number() over (order by listener_id) i from (select distinct listener_id from word_trials)) w on w.i=x.i group by all"""


@query("m13_bootstrap_brier", f"""select round(quantile_cont(v,0.025),6) lo, round(quantile_cont(v,0.975),6) hi, count(v) n_valid, count(*) n_resamples from (select b, sum(w*num)/sum(w*den) v from ({DRAWN}) d
  join (select listener_id, sum(power(score-misheard,2)) num, count(*) den from word_trials group by all) p on p.listener_id=d.listener_id group by b)""")
def _(t):
    drawn = mt.draws(t.word_trials, B)
    v = mt.bootstrap_ratio(t.word_trials, F.pow(F.col("score") - F.col("misheard"), 2), F.lit(1), drawn, [])
    return rnd(mt.intervals(v, [], "value"))


BOOT_SRC = f"(select b, s, sum(w*pos) pos, sum(w*neg) neg from ({DRAWN}) d join (select listener_id, SCORE s, sum(misheard) pos, sum(1-misheard) neg from word_trials group by all) p on p.listener_id=d.listener_id group by all)"


def boot_ap(score):
    return f"""select b, sum(pos/tp*(tp-cp+pos)/(tp+tn-cn+pos+neg)) pr_auc from (select *, sum(pos+neg) over (partition by b order by s) cn, sum(pos) over (partition by b order by s) cp,
   sum(pos) over (partition by b)::double tp, sum(neg) over (partition by b)::double tn from {BOOT_SRC.replace('SCORE', score)}) group by b"""


@query("m13_bootstrap_ap", f"select round(quantile_cont(pr_auc,0.025),6) lo, round(quantile_cont(pr_auc,0.975),6) hi, count(pr_auc) n_valid, count(*) n_resamples from ({boot_ap('score')})")
def _(t):
    v = mt.bootstrap_rank(t.word_trials, mt.draws(t.word_trials, B), [])
    return rnd(mt.intervals(v, [], "pr_auc"))


PAIRED = f"select a.b, a.pr_auc-z.pr_auc v from ({boot_ap('score')}) a join ({boot_ap('round(score*4,0)/4')}) z on a.b=z.b"


def _arms(t):
    each = F.array(F.struct(F.lit("fine").alias("arm"), F.col("score").alias("arm_score")),
                   F.struct(F.lit("coarse").alias("arm"), (F.round(F.col("score") * 4) / 4).alias("arm_score")))
    return t.word_trials.select("row_id", "seed", "listener_id", "misheard", "score", F.inline_outer(each))


@query("m14_paired_bootstrap", f"select round(quantile_cont(v,0.025),6) lo, round(quantile_cont(v,0.975),6) hi, count(v) n_valid, count(*) n_resamples from ({PAIRED})")
def _(t):
    v = mt.bootstrap_rank(_arms(t), mt.draws(t.word_trials, B), ["arm"], p="arm_score")
    return rnd(mt.intervals(mt.paired_difference(v, "arm", "fine", "coarse", "pr_auc"), [], "value"))


@query("m15_excludes_zero", f"select lo>0 or hi<0 excludes_zero from (select quantile_cont(v,0.025) lo, quantile_cont(v,0.975) hi from ({PAIRED}))")
def _(t):
    v = mt.bootstrap_rank(_arms(t), mt.draws(t.word_trials, B), ["arm"], p="arm_score")
    i = mt.intervals(mt.paired_difference(v, "arm", "fine", "coarse", "pr_auc"), [], "value")
    return mt.excludes_zero(i).select("excludes_zero")


ARMS = {"fine": "score", "coarse": "round(score*4,0)/4", "other": "score_b"}
PAIRS = (("fine", "coarse"), ("fine", "other"))


def seed_ap(score):
    src = f"(select seed, b, s, sum(w*pos) pos, sum(w*neg) neg from ({DRAWN}) d join (select seed, listener_id, {score} s, sum(misheard) pos, sum(1-misheard) neg from word_trials group by all) p on p.listener_id=d.listener_id group by all)"
    return f"""(select seed, b, sum(pos/tp*(tp-cp+pos)/(tp+tn-cn+pos+neg)) pr_auc from (select *, sum(pos+neg) over (partition by seed, b order by s) cn, sum(pos) over (partition by seed, b order by s) cp,
   sum(pos) over (partition by seed, b)::double tp, sum(neg) over (partition by seed, b)::double tn from {src}) group by all)"""


def armed(*names):
    return "(" + " union all ".join(f"select seed, listener_id, misheard, '{a}' arm, {ARMS[a]} arm_score from word_trials" for a in names) + ")"


ARMED = armed("fine", "coarse")
CONTRASTS = "(" + " union all ".join(f"""select p.seed, '{a}' arm, '{r}' reference, point, lo, hi, n_valid, lo>0 or hi<0 excludes_zero
  from (select seed, max(case when arm='{a}' then pr_auc end)-max(case when arm='{r}' then pr_auc end) point from ({auc_sql('seed, arm', armed(a, r), 'arm_score')}) group by seed) p
  join (select x.seed, quantile_cont(x.pr_auc-y.pr_auc,0.025) lo, quantile_cont(x.pr_auc-y.pr_auc,0.975) hi, count(x.pr_auc-y.pr_auc) n_valid from {seed_ap(ARMS[a])} x join {seed_ap(ARMS[r])} y on x.seed=y.seed and x.b=y.b group by x.seed) i on p.seed=i.seed""" for a, r in PAIRS) + ")"


def contrasts(t):
    score = {"fine": F.col("score"), "coarse": F.round(F.col("score") * 4) / 4, "other": F.col("score_b")}
    rows = t.word_trials.select("seed", "listener_id", "misheard", F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), s.alias("arm_score")) for a, s in score.items()])))
    per = durable(mt.score_counts(rows, ["seed", "arm", "listener_id"], p="arm_score"))  # points and resamples start from it
    points = mt.rank_metrics(per.groupBy("seed", "arm", "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), ["seed", "arm"])
    resampled = mt.resampled_rank(per, mt.draws(t.word_trials, B), ["seed", "arm"])
    return st.contrasts(points, resampled, ["seed"], "pr_auc", PAIRS)


@query("m16_contrasts", f"select seed, arm, reference, round(point,6) point, round(lo,6) lo, round(hi,6) hi, n_valid, excludes_zero from {CONTRASTS}")
def _(t):
    return rnd(contrasts(t).drop("n_resamples"))


@query("m17_seed_summary", f"select round(avg(pr_auc),6) mean, round(stddev_samp(pr_auc),6) sd, round(min(pr_auc),6) min, round(max(pr_auc),6) max, count(*) n from ({auc_sql('seed')})")
def _(t):
    return rnd(mt.seed_summary(mt.rank_metrics(counts(t), S), [], "pr_auc"))


@query("m18_contrast_summary", f"""select arm, reference, round(avg(point),6) difference, count(*) filter (where excludes_zero) n_seeds_excluding_zero, count(*) n_seeds,
  count(distinct case when point<>0 then sign(point) end)<=1 consistent_direction from {CONTRASTS} group by all""")
def _(t):
    return rnd(mt.contrast_summary(contrasts(t), ["arm", "reference"]))
