"""Models (G) and extension points (Z)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonrisk.operators import artifacts as ar
from phonrisk.operators import features as ft
from phonrisk.operators import metrics as mt
from phonrisk.operators import models as md
from phonrisk.operators import policy as po
from phonrisk.operators import quality as ql
from phonrisk.operators import splits as sp
from phonrisk.operators.ordered import rank_rows
from phonrisk.session import scratch_dir, stored
from phonrisk.suite import q_features as qf
from phonrisk.suite.q_features import rnd
from phonrisk.suite.registry import query

LIVE = "live_word_context_clinical_confusion"


def data(t, arm="clinical_plus_confusion"):
    return stored(qf.matrix(t, arm), "matrix"), ft.arm_columns(arm)


def _scored(fit, **kw):
    def run(t):
        m, cols = data(t)
        return rnd(fit(m, cols, **kw).predict(m, "p").select("row_id", "p"))
    return run


@query("g01_independence_model", "select t.row_id, round(least(greatest(x.x_r_phon,0),1),6) p from word_trials t join xblock x on x.listener_id=t.listener_id and x.word=t.word")
def _(t):
    return rnd(qf.matrix(t, "confusion_only").select("row_id", md.independence().alias("p")))


query("g02_logistic")(_scored(md.fit_logistic))


@query("g02_scaling_inputs", "select round(quantile_cont(h.better_ear_pta,0.5),6) med_pta, round(avg(coalesce(h.better_ear_pta, q.m)),6) mean_pta, round(stddev_pop(coalesce(h.better_ear_pta, q.m)),6) sd_pta from word_trials t join hear h on h.listener_id=t.listener_id join cal_listeners c on c.listener_id=t.listener_id cross join (select quantile_cont(h.better_ear_pta,0.5) m from word_trials t join hear h on h.listener_id=t.listener_id join cal_listeners c on c.listener_id=t.listener_id) q")
def _(t):
    m, _ = data(t)
    s = md.fit_scaling(m, ["h_pta_better"])
    return rnd(t.spark.createDataFrame([(s.medians[0], s.means[0], s.sds[0])], "med_pta double, mean_pta double, sd_pta double"))


@query("g03_coefficients")
def _(t):
    m, cols = data(t)
    return rnd(md.fit_logistic(m, cols).coefficients(t.spark))


query("g04_boosted_trees")(_scored(md.fit_boosted))
query("g05_residual")(_scored(md.fit_residual))
query("g06_cross_fitted_residual")(_scored(md.fit_cross_fitted))
query("g07_spline_additive")(_scored(md.fit_additive))
query("g08_listener_ranking")(_scored(md.fit_listwise_ranker))


@query("g09_canonical_order", "select listener_id, row_id from word_trials")
def _(t):
    df = t.word_trials.select("listener_id", "row_id", "word", "misheard")
    return rank_rows(df, ["listener_id"], md.canonical_order(df)).select("listener_id", "row_id")


query("g10_pairwise_ranker")(_scored(md.fit_pairwise_ranker))


@query("g11_platt")
def _(t):
    m, cols = data(t)
    return rnd(md.fit_calibrated(m, cols, md.fit_logistic, method="platt").predict(m).select("row_id", "p"))


@query("g12_isotonic")
def _(t):
    m, cols = data(t)
    return rnd(md.fit_calibrated(m, cols, md.fit_logistic, method="isotonic").predict(m).select("row_id", "p"))


FOLD0 = "(select listener_id, rn<=least(greatest(round_even(0.25::double*nn,0),1),nn-1) held_out from (select listener_id, row_number() over (order by cast(concat('0x',substr(md5(concat('fold0:',listener_id::varchar)),1,8)) as bigint), listener_id) rn, count(*) over () nn from (select distinct listener_id from word_trials)))"


@query("g13_calibration_fallback", f"select snr_db, 'platt' requested_method, case when min(misheard)=max(misheard) then 'none' else 'platt' end effective_method, count(*) n_slice from word_trials t join {FOLD0} f on f.listener_id=t.listener_id where f.held_out group by all")
def _(t):
    held = t.word_trials.join(sp.calibration_holdout(t.word_trials), "listener_id").where("held_out")
    one = F.min("misheard") == F.max("misheard")
    return held.groupBy("snr_db").agg(F.lit("platt").alias("requested_method"), F.when(one, "none").otherwise("platt").alias("effective_method"), F.count("*").alias("n_slice"))


@query("g14_out_of_fold")
def _(t):
    m, cols = data(t)
    oof, _log = md.out_of_fold(m, cols, md.fit_logistic)
    if not sp.prediction_gaps(m, oof).isEmpty():
        raise ValueError("some rows were not predicted exactly once")
    return rnd(mt.suite(oof, [], p="p"))


@query("g15_batch_scoring")
def _(t):
    m, cols = data(t, LIVE)
    model = md.fit_logistic(m, cols)
    known = t.tokens.select("listener_id", F.col("text").alias("word")).distinct()
    words = known.where(F.col("word").rlike("[가-힣]")).select("*", F.xxhash64("listener_id", "word").alias("row_id"), F.lit(0).alias("misheard"))
    risks = model.predict(qf.matrix(t, LIVE, words, keep=("listener_id", "word")), "risk")
    return rnd(po.attach_risk(t.tokens, risks).select("media_id", "tok_idx", "reason", "risk"))


@query("g16_live_artifact")
def _(t):
    m, cols = data(t, LIVE)
    ql.check_blocks(LIVE)
    ql.check_columns(cols)
    path, digest = scratch_dir(t.spark, "model"), ql.schema_hash(cols)
    md.save_linear(md.fit_logistic(m, cols), t.spark, path, contract=ql.LIVE_CONTRACT, schema_hash=digest, arm=LIVE)
    return rnd(md.load_linear(t.spark, path, schema_hash=digest).predict(m).select("row_id", "p"))


@query("g16_media_artifact")
def _(t):
    """A calibrated model over all seeds, saved for recorded media and loaded again."""
    cols = ft.arm_columns("clinical_plus_confusion")
    m = stored(qf.matrix(t, "clinical_plus_confusion", keep=("row_id", "listener_id", "misheard", "seed")), "matrix")
    path = scratch_dir(t.spark, "model")
    fitted = ar.fit_over_seeds(m, cols, lambda rows, c: md.fit_calibrated(rows, c, md.fit_residual))
    seeds = [r.seed for r in m.select("seed").distinct().orderBy("seed").collect()]
    ar.save_model(fitted, t.spark, path, name="residual", cols=cols, contract=ar.MEDIA_CONTRACT, arm="clinical_plus_confusion", seeds=seeds)
    model, _ = ar.load_model(t.spark, path, cols=cols, contract=ar.MEDIA_CONTRACT)
    return rnd(model.predict(m, "p").select("row_id", "p"))


@query("z01_pluggable_policy", "select media_id, tok_idx, case when confidence is not null and listener_risk>0.5 then 'shown_high_risk' else 'hidden' end decision from tokens")
def _(t):
    def policy(words):
        return words.withColumn("decision", F.when(F.col("confidence").isNotNull() & (F.col("listener_risk") > 0.5), "shown_high_risk").otherwise("hidden"))
    po.POLICIES.pop("confident", None)
    po.register_policy("confident", policy)
    return po.apply_policy(t.tokens, "confident").select("media_id", "tok_idx", "decision")


@query("z02_model_registry")
def _(t):
    m, cols = data(t, LIVE)
    out = None
    for name in ("logistic", "residual"):
        row = mt.suite(md.MODELS[name](m, cols).predict(m, "p"), [], p="p").select(F.lit(name).alias("model"), "pr_auc", "brier")
        out = row if out is None else out.unionByName(row)
    return rnd(out)


@query("z03_bootstrap_statistic", """select round(quantile_cont(v,0.025),6) lo, round(quantile_cont(v,0.975),6) hi, count(v) n_valid, count(*) n_resamples from (select b, sum(w*num)/sum(w*den) v from (select b, w.listener_id, count(*) w from
  (select b.range b, 1 + cast(concat('0x',substr(md5(concat('boot0:',b.range::varchar,':',d.range::varchar)),1,15)) as bigint) % (select count(distinct listener_id) from word_trials) i from range(1000) b cross join range((select count(distinct listener_id) from word_trials)) d) x
  join (select listener_id, row_number() over (order by listener_id) i from (select distinct listener_id from word_trials)) w on w.i=x.i group by all) d join (select listener_id, sum(misheard*score) num, sum(misheard) den from word_trials group by all) p on p.listener_id=d.listener_id group by b)""")
def _(t):
    sums = {"hit": F.col("misheard") * F.col("score"), "all": F.col("misheard")}
    v = mt.bootstrap_statistic(t.word_trials, sums, F.try_divide("hit", "all"), mt.draws(t.word_trials, 1_000), [])
    return rnd(mt.intervals(v, [], "value"))


@query("z04_unicode_forms", "select count(*) n, count(*) filter (where nfc_normalize(text)=text) n_composed from documents")
def _(t):
    from phonrisk.functions.text import nfc
    return t.documents.agg(F.count("*").alias("n"), F.count_if(nfc(F.col("text")) == F.col("text")).alias("n_composed"))


@query("z05_long_alignment")
def _(t):
    from phonrisk.operators import asr
    return asr.edit_counts(asr.normalised(t.utterances), "ref_chars", "hyp_chars", "c_", ["utt_id"])


@query("z06_phoneme_rows", "select position, symbol, count(*) n from phon_vocab group by all")
def _(t):
    from phonrisk.functions import hangul as hg
    syl = t.word_vocab.select("word").distinct().select(F.explode_outer(hg.syllables(F.col("word"))).alias("s")).where("s is not null")
    return syl.select(F.inline_outer(hg.jamo(F.col("s")))).groupBy("position", "symbol").agg(F.count("*").alias("n"))
