"""Feature engineering (F) and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonrisk.operators import confusion as cf
from phonrisk.operators import dims
from phonrisk.operators import features as ft
from phonrisk.operators import walk
from phonrisk.suite import q_confusion as qc
from phonrisk.suite import q_hearing as qh
from phonrisk.suite.registry import query, r6

K = ["listener_id"]
PAIR = ["listener_id", "word"]
XNAMES = [c for c in ft.arm_columns("confusion_only") if c.startswith("x_")]


def rnd(df: DataFrame, *skip: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def pairs(t):
    return t.word_trials.select(*PAIR).distinct()


def evidence(t):
    return ft.with_evidence(pairs(t), qc.profiles(t), K)


def block(t, name, wanted=lambda c: True, ev=None):
    """The block's columns that are ``wanted``, of every pair."""
    return rnd(walk.evidence_blocks(evidence(t) if ev is None else ev, PAIR, [name], [c for c in ft.block_columns([name]) if wanted(c)]))


@query("flagship_risky_words", """select listener_id, word, round(risk,6) risk, position, target, round(p_correct,6) p_correct, n_observations from (
  select r.*, e.position, e.symbol target, e.p p_correct, e.n n_observations, row_number() over (partition by r.listener_id, r.word order by e.p, e.si, case e.position when 'onset' then 0 when 'nucleus' then 1 else 2 end) k
  from (select listener_id, word, 1-exp(sum(ln(greatest(p,1e-6)))) risk, row_number() over (partition by listener_id order by round(1-exp(sum(ln(greatest(p,1e-6)))),9) desc, word collate "binary") rn,
   count(*) over (partition by listener_id) nn from evid group by listener_id, word) r join evid e on e.listener_id=r.listener_id and e.word=r.word where rn <= round_even(0.2*nn,0)) where k=1""")
def _(t):
    from phonrisk.operators.ordered import is_bounded, rank_rows

    fits = is_bounded(t.word_trials, K)  # no listener has more words than trials
    scored = evidence(t).select(*PAIR, ft.independence_risk().alias("risk"), F.array_min(F.transform("slots", lambda s, i: F.struct(
        ft.At(s)["p"].alias("p_correct"), i.alias("i"), s.alias("slot"), ft.At(s)["n"].alias("n_observations")))).alias("w"))
    ranked = rank_rows(scored, K, [F.round("risk", 9).desc(), "word"], total="nn", bounded=fits)
    pos, symbol = ft.slot_name(F.col("w.slot"))
    return rnd(ranked.where("rn <= rint(0.2D * nn)").select(
        *PAIR, "risk", pos.alias("position"), symbol.alias("target"), "w.p_correct", "w.n_observations"))


WCOLS = ft.arm_columns("live_word_context")


@query("f01_word_block", "select word, " + ", ".join(f"round({c},6) {c}" for c in WCOLS) + " from wblock")
def _(t):
    return rnd(ft.word_block(t.word_vocab.select("word").distinct()))


@query("f02_context_block", "select row_id, snr_db::double c_snr_db, (speaker='female')::int::double c_speaker_female, (speaker='male')::int::double c_speaker_male, (speaker='unknown')::int::double c_speaker_unknown from word_trials")
def _(t):
    return t.word_trials.select("row_id", *[c.alias(n) for n, c in ft.context_columns().items()])


PARTS: dict[str, str] = {}


def _part(name, sql):
    """A block's query, whose SQL the arms' matrices are made of."""
    PARTS[name] = sql
    return query(name, sql)


def _h(values):
    return ", ".join(f"round({e},6) {n}, ({e} is null)::int::double {n}_missing" for n, e in values.items())


PTA = {"h_pta_better": "better_ear_pta", "h_pta_worse": "worse_ear_pta", "h_pta_asymmetry": "worse_ear_pta-better_ear_pta",
       "h_audiogram_slope": "audiogram_slope", "h_high_freq_mean": "high_freq_mean"}
CLIN = PTA | {"h_srt": "srt", "h_srt_minus_pta": "srt-better_ear_pta", "h_wrs": "wrs", "h_pbmax": "pbmax", "h_mcl": "mcl"}


@query("f03_pta_block", f"select listener_id, {_h(PTA)} from hear")
def _(t):
    return rnd(qh.summary(t).select("listener_id", *[c.alias(n) for n, c in ft.pta_columns().items()]))


@query("f04_clinical_block", f"select listener_id, {_h(CLIN)} from hear")
def _(t):
    return rnd(qh.summary(t).select("listener_id", *[c.alias(n) for n, c in ft.clinical_columns().items()]))


@query("f05_coda_backoff", "select listener_id, symbol target, round(p,6) p_correct, n n_observations, backed_off, count(*) n_uses from evid where position='coda' group by all")
def _(t):
    r = ft.phoneme_risks(evidence(t), PAIR).where("position = 'coda'")
    return (rnd(r).groupBy("listener_id", "target", "p_correct", "n_observations", "backed_off").agg(F.count("*").alias("n_uses")))


@query("f06_phoneme_evidence", "select listener_id, word, si-1 syllable_idx, position, symbol target, round(p,6) p_correct, n n_observations, backed_off from evid")
def _(t):
    return rnd(ft.phoneme_risks(evidence(t), PAIR))


@query("f06_top_confusions", """select e.listener_id, e.word, e.si-1 syllable_idx, e.position, e.symbol target, c.rank, c.perceived, round(c.p,6) p, c.n
  from evid e join (select *, row_number() over (partition by listener_id, position, target order by p desc, p_idx) rank from post where target<>perceived) c
  on c.listener_id=e.listener_id and c.position=e.position and c.target=e.symbol where c.rank<=2""")
def _(t):
    ev = ft.with_evidence(pairs(t), ft.profile_vectors(qc.estimated(t), K, tops=2), K)
    rows = ft.phoneme_risks(ev, PAIR).select(*PAIR, "syllable_idx", "position", "target", F.posexplode("top_confusions").alias("i", "c"))
    return rnd(rows.select(*PAIR, "syllable_idx", "position", "target", (F.col("i") + 1).alias("rank"), "c.perceived", "c.p", "c.n"))


@query("f07_independence_risk", "select listener_id, word, round(1-exp(sum(ln(greatest(p,1e-6)))),6) risk from evid group by all")
def _(t):
    return rnd(evidence(t).select(*PAIR, ft.independence_risk().alias("risk")))


@query("f08_confusion_block", "select listener_id, word, " + ", ".join(f"round({c},6) {c}" for c in XNAMES) + " from xblock")
def _(t):
    return block(t, "confusion")


@query("f09_class_weakness", "select listener_id, cls as class, round(w,6) weakness from weak")
def _(t):
    return rnd(ft.class_weakness(qc.estimated(t), K))


def _pivot(prefix, value, src):
    return ", ".join(f"round(coalesce(sum(case when {src}.cls='{c}' then {value} end),0),6) \"{prefix}{c}\"" for c in dims.CLASS_NAMES)


@_part("f10_class_share", f"select word, {_pivot('w2_', 'sh', 's')} from share s group by all")
def _(t):
    w = t.word_vocab.select("word").distinct().withColumn("slots", ft.word_slots(F.col("word")))
    return rnd(w.select("word", *[c.alias(f"w2_{n}") for n, c in ft.class_share_columns().items()]))


def _with_weak(t):
    return ft.with_evidence(pairs(t), ft.weakness_of(qc.profiles(t)), K)


@_part("f11_interaction_block", f"select p.listener_id, p.word, {_pivot('ix_', 'w*sh', 's')} from pairs p join share s on s.word=p.word join weak k on k.listener_id=p.listener_id and k.cls=s.cls group by all")
def _(t):
    return block(t, "confusion_rich", lambda c: c.startswith("ix_"), _with_weak(t))


@_part("f12_error_concentration", "select listener_id, word, round(avg(top1/mass),6) x2_top1_share, round(avg(same/mass),6) x2_within_class_share, round(avg((mass-same)/mass),6) x2_across_class_share from evx group by all")
def _(t):
    return block(t, "confusion_rich", {"x2_top1_share", "x2_within_class_share", "x2_across_class_share"}.__contains__, _with_weak(t))


SD = "sqrt(least(greatest(p,1e-6),1-1e-6)*(1-least(greatest(p,1e-6),1-1e-6))/(n+2.0))"


@_part("f13_posterior_spread", f"select listener_id, word, round(avg({SD}),6) x2_post_sd_mean, round(max({SD}),6) x2_post_sd_max, round(avg(case when n<3 then 1.0 else 0 end),6) x2_frac_thin_evidence from evx group by all")
def _(t):
    return block(t, "confusion_rich", {"x2_post_sd_mean", "x2_post_sd_max", "x2_frac_thin_evidence"}.__contains__, _with_weak(t))


@_part("f14_rich_tail", """select listener_id, word, round(list_avg(list_sort(list(p))[1:2]),6) x2_worst_two_mean, round(max(p)-min(p),6) x2_p_spread,
  round(min(case when position='onset' then p end),6) x2_min_p_onset, round(min(case when position='nucleus' then p end),6) x2_min_p_nucleus, round(min(case when position='coda' then p end),6) x2_min_p_coda from evx group by all""")
def _(t):
    names = {"x2_worst_two_mean", "x2_p_spread", "x2_min_p_onset", "x2_min_p_nucleus", "x2_min_p_coda"}
    return block(t, "confusion_rich", names.__contains__, _with_weak(t))


@_part("f15_exact_target_block", "select listener_id, word, " + ", ".join(
    f"round(coalesce(sum(case when position='{p}' and t_idx={i} then 1-own_p end),0),6) et_{p}{i:02d}" for p, n in (("onset", 19), ("nucleus", 21), ("coda", 28)) for i in range(n)) + " from evid group by all")
def _(t):
    return block(t, "exact_target")


OSD = SD.replace("(p,", "(own_p,").replace("(n+", "(own_n+")


@_part("f16_exact_offdiag_block", "select listener_id, word, " + ", ".join(
    f"""round(sum(own_mass) filter (where position='{p}'),6) eo_{p}_expected_errors, round(avg(same) filter (where position='{p}'),6) eo_{p}_within_class,
    round(avg(own_mass-same) filter (where position='{p}'),6) eo_{p}_across_class, round(avg(top1/own_mass) filter (where position='{p}'),6) eo_{p}_top1_share,
    round(avg(own_n) filter (where position='{p}'),6) eo_{p}_evidence, round(avg({OSD}) filter (where position='{p}'),6) eo_{p}_uncertainty""" for p in ("onset", "nucleus", "coda")) + " from evx group by all")
def _(t):
    return block(t, "exact_target_offdiag")


def matrix(t, arm, trials=None, **kw):
    return ft.feature_matrix(trials if trials is not None else t.word_trials, arm, hearing=qh.summary(t), est=qc.profiles(t), **kw)


MATRIX = """select t.row_id, t.listener_id, t.misheard, {cols} from word_trials t join wblock w on w.word=t.word join xblock x on x.listener_id=t.listener_id and x.word=t.word
  join (select listener_id, {h} from hear) c on c.listener_id=t.listener_id"""
CCOLS = "t.snr_db::double c_snr_db, (speaker='female')::int::double c_speaker_female, (speaker='male')::int::double c_speaker_male, (speaker='unknown')::int::double c_speaker_unknown"


@query("f17_arm_combined", MATRIX.format(h=_h(CLIN), cols=", ".join([f"round(w.{c},6) {c}" for c in WCOLS] + [CCOLS, "c.* exclude (listener_id)"] + [f"round(x.{c},6) {c}" for c in XNAMES])))
def _(t):
    return rnd(matrix(t, "clinical_plus_confusion"))


def _arm_sql(arm):
    """A whole matrix from the SQL of its blocks."""
    blocks, cols, joins = ft.ARMS[arm], [f"round(w.{c},6) {c}" for c in WCOLS], ["join wblock w on w.word=t.word"]
    pair = lambda name, a: f"join ({PARTS[name]}) {a} on {a}.listener_id=t.listener_id and {a}.word=t.word"
    if "context" in blocks:
        cols.append(CCOLS)
    if {"pta", "clinical"} & set(blocks):
        cols.append("c.* exclude (listener_id)")
        joins.append(f"join (select listener_id, {_h(CLIN if 'clinical' in blocks else PTA)} from hear) c on c.listener_id=t.listener_id")
    if "confusion" in blocks:
        cols += [f"round(x.{c},6) {c}" for c in XNAMES]
        joins.append("join xblock x on x.listener_id=t.listener_id and x.word=t.word")
    if "confusion_rich" in blocks:
        cols.append("s.* exclude (word)")
        joins.append(f"join (select v.* from ({PARTS['f10_class_share']}) v) s on s.word=t.word")
        for a, name in (("i", "f11_interaction_block"), ("e", "f12_error_concentration"), ("d", "f13_posterior_spread"), ("r", "f14_rich_tail")):
            cols.append(f"{a}.* exclude (listener_id, word)")
            joins.append(pair(name, a))
    for block, a, name in (("exact_target", "k", "f15_exact_target_block"), ("exact_target_offdiag", "o", "f16_exact_offdiag_block")):
        if block in blocks:
            cols.append(f"{a}.* exclude (listener_id, word)")
            joins.append(pair(name, a))
    return f"select t.row_id, t.listener_id, t.misheard, {', '.join(cols)} from word_trials t {' '.join(joins)}"


for _arm in ft.ARMS:
    if _arm not in ("clinical_plus_confusion", "live_word_context_clinical_confusion"):  # f17_arm_combined and f18 below
        query(f"f17_arm_{_arm}", _arm_sql(_arm))(lambda t, arm=_arm: rnd(matrix(t, arm)))


@query("f17_missing_inputs", "select distinct listener_id, 'no confusion profile' as reason from word_trials where listener_id not in (select listener_id from cal_listeners) union all select distinct listener_id, 'no hearing profile' from word_trials where listener_id not in (select listener_id from hear)")
def _(t):
    return ft.missing_inputs(t.word_trials, "clinical_plus_confusion", hearing=qh.summary(t), est=qc.estimated(t))


@query("f18_cohort_matrix_live", MATRIX.format(h=_h(CLIN), cols=", ".join([f"round(w.{c},6) {c}" for c in WCOLS] + ["c.* exclude (listener_id)"] + [f"round(x.{c},6) {c}" for c in XNAMES])))
def _(t):
    return rnd(matrix(t, "live_word_context_clinical_confusion"))


@query("f19_scored_once", "select t.row_id, round(x.x_r_phon,6) risk from word_trials t join xblock x on x.listener_id=t.listener_id and x.word=t.word")
def _(t):
    risk = evidence(t).select(*PAIR, ft.independence_risk().alias("risk"))
    return rnd(t.word_trials.select("row_id", *PAIR).join(risk, PAIR).select("row_id", "risk"))


@query("f20_stacked_cohorts", "select seed, count(*) n, count(distinct listener_id) n_listeners, round(avg(w.w_n_syllables),6) mean_len from word_trials t join wblock w on w.word=t.word group by all")
def _(t):
    from functools import reduce
    base = matrix(t, "word_context_only", keep=("row_id", "listener_id", "misheard", "seed"))
    parts = [base.where(F.col("seed") == s) for s in range(1, 6)]
    stacked = reduce(DataFrame.unionByName, parts)
    return rnd(stacked.groupBy("seed").agg(F.count("*").alias("n"), F.countDistinct("listener_id").alias("n_listeners"), F.avg("w_n_syllables").alias("mean_len")))
