"""Joins (J), splits (K), cohort statistics (N) and recogniser evaluation (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonrisk.operators import asr, cohort, confusion as cf, lexicon as lx, metrics as mt, splits as sp
from phonrisk.operators import features as ft
from phonrisk.operators.ordered import rank_rows
from phonrisk.suite import q_confusion as qc
from phonrisk.suite import q_hearing as qh
from phonrisk.suite.q_features import evidence, rnd
from phonrisk.suite.registry import query

L = ["listener_id"]


@query("j01_words_by_estimates", "select listener_id, word, position, count(*) n, round(avg(p),6) mean_p from evid group by all")
def _(t):
    r = ft.phoneme_risks(evidence(t), ["listener_id", "word"])
    return rnd(r.groupBy("listener_id", "word", "position").agg(F.count("*").alias("n"), F.avg("p_correct").alias("mean_p")))


@query("j02_backoff_join", "select listener_id, count(*) n, count(*) filter (where backed_off) n_backed_off from evid group by all")
def _(t):
    return ft.phoneme_risks(evidence(t), ["listener_id"]).groupBy("listener_id").agg(F.count("*").alias("n"), F.count_if("backed_off").alias("n_backed_off"))


REF = """(select v, string_agg(chr(cast(44032 + (p%19*21+p%21)*28 + case p%8 when 0 then 0 when 1 then 1 when 2 then 4 when 3 then 7 when 4 then 8 when 5 then 16 when 6 then 17 else 21 end as integer)), '' order by j) word
  from (select v, j, (st+j)%3192 p from (select v, n_syll, st, unnest(range(0, n_syll)) j from (select v, n_syll, sum(n_syll) over (order by v)-n_syll st from (select range v, case when range<80 then 1 when range<260 then 2 when range<360 then 3 else 4 end n_syll from range(400))))) group by v)"""


@query("j03_listener_vocabulary", f"select l.listener_id, count(*) n, count(distinct r.word) n_words from cal_listeners l cross join {REF} r group by all")
def _(t):
    from phonrisk.streaming.live import vocabulary_lists
    return vocabulary_lists(t.calib_trials.select("listener_id").distinct()).select(
        "listener_id", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("n_words"))


def _stirred() -> str:
    """Pair places after each keyed shift, as nested selects over ``picked``."""
    sql = "select listener_id, m, n, i//n a, i%n b from picked"
    for r in range(lx.ROUNDS):
        x, o, size = ("a", "b", "m") if r % 2 == 0 else ("b", "a", "n")
        shift = f"cast(concat('0x',substr(md5(concat('pair0:',listener_id::varchar,':{r}:',{o}::varchar)),1,15)) as bigint)"
        sql = f"select listener_id, m, n, {o}, ({x} + {shift}%{size})%{size} {x} from ({sql})"
    return sql


@query("j04_sampled_pairs", f"""with sides as (select listener_id, misheard, row_id, row_number() over (partition by listener_id, misheard order by
    cast(concat('0x',substr(md5(concat('side0:',row_id::varchar)),1,15)) as bigint), row_id) k from word_trials),
  sizes as (select listener_id, count(*) filter (where misheard=1) m, count(*) filter (where misheard=0) n from sides group by all),
  picked as (select listener_id, m, n, unnest(range(0, least(m*n,400))) i from sizes where m*n>0)
  select z.listener_id, p.row_id pos_row, q.row_id neg_row from ({_stirred()}) z join sides p on p.listener_id=z.listener_id and p.misheard=1 and p.k=z.a+1
  join sides q on q.listener_id=z.listener_id and q.misheard=0 and q.k=z.b+1""")
def _(t):
    return lx.sampled_pairs(t.word_trials, 400).select("listener_id", "pos_row", "neg_row")


MASK = """(select word, i, string_agg(case when k=i then '*' else concat(position, symbol) end, '.' order by k) pat from (select a.*, b.k i from
  (select *, row_number() over (partition by word order by si, case position when 'onset' then 0 when 'nucleus' then 1 else 2 end) k from phon_vocab) a join
  (select word, row_number() over (partition by word order by si, case position when 'onset' then 0 when 'nucleus' then 1 else 2 end) k from phon_vocab) b on a.word=b.word) group by word, i)"""


@query("j05_minimal_pairs", f"select a.word, count(distinct b.word) n_neighbours from {MASK} a left join {MASK} b on a.pat=b.pat and a.word<>b.word group by all")
def _(t):
    return lx.competitors(t.word_vocab)


@query("j05_neighbours_of_heard", f"""select distinct f.perceived_word, b.word neighbour from (select distinct perceived_word from word_trials) f
  join {MASK} a on a.word=f.perceived_word join {MASK} b on a.pat=b.pat and b.word<>f.perceived_word""")
def _(t):
    known = t.word_vocab.select(F.col("word").alias("perceived_word")).distinct()
    heard = t.word_trials.select("perceived_word").distinct().join(known, "perceived_word", "left_semi")
    return lx.neighbours_of(heard, t.word_vocab, "perceived_word")


@query("j06_heard_words", "select is_word, count(*) n from (select t.row_id, t.perceived_word in (select word from word_vocab) is_word from word_trials t) group by all")
def _(t):
    return lx.known_forms(t.word_trials, t.word_vocab).groupBy("is_word").agg(F.count("*").alias("n"))


def _seeded(score):
    return f"select seed, avg(power({score}-misheard,2)) v from word_trials group by all"


@query("j07_paired_by_seed", f"select count(*) n_seeds, round(avg(a.v-b.v),6) mean, round(stddev_samp(a.v-b.v),6) sd, count(*) filter (where a.v-b.v>0) n_positive from ({_seeded('score')}) a join ({_seeded('score_b')}) b on a.seed=b.seed")
def _(t):
    from phonrisk.plans.studies import paired
    a, b = (mt.probability_metrics(mt.score_counts(t.word_trials, ["seed"], p=p), ["seed"]).select("seed", F.lit(p).alias("arm"), "brier") for p in ("score", "score_b"))
    return rnd(paired(a.unionByName(b), "arm", "score", "score_b", "brier"))


@query("j08_alignment_check", "select count(*) n_bad from (select * from word_trials where n_segment_errors>0) a full join word_trials b on a.row_id=b.row_id where a.row_id is null or b.row_id is null or a.misheard<>b.misheard")
def _(t):
    from phonrisk.plans.studies import misaligned
    return misaligned(t.word_trials.where("n_segment_errors > 0"), t.word_trials, "row_id", "misheard").agg(F.count("*").alias("n_bad"))


@query("j09_shared_listeners", "select listener_id from word_trials where speaker='male' intersect select listener_id from word_trials where speaker='female'")
def _(t):
    return sp.shared_listeners(t.word_trials.where("speaker = 'male'"), t.word_trials.where("speaker = 'female'"))


@query("j10_missing_cells", "select a.seed, b.snr_db, c.speaker from (select distinct seed from word_trials) a cross join (values (20),(10),(5),(0),(-5)) b(snr_db) cross join (values ('male'),('female'),('child')) c(speaker) except select distinct seed, snr_db, speaker from word_trials")
def _(t):
    from phonrisk.plans.studies import missing_cells
    cells = t.word_trials.select("seed", "snr_db", "speaker").distinct()
    return missing_cells(cells, {"seed": [1, 2, 3, 4, 5], "snr_db": [20, 10, 5, 0, -5], "speaker": ["male", "female", "child"]})


@query("j11_union_of_points", "select 'score' src, seed, round(avg(score),6) v from word_trials group by all union all select 'score_b', seed, round(avg(score_b),6) from word_trials group by all")
def _(t):
    parts = [t.word_trials.groupBy("seed").agg(F.avg(p).alias("v")).select(F.lit(p).alias("src"), "seed", "v") for p in ("score", "score_b")]
    return rnd(parts[0].unionByName(parts[1]))


@query("j12_top_k", "select listener_id, row_id, rn from (select listener_id, row_id, row_number() over (partition by listener_id order by score_b desc, row_id) rn from word_trials) where rn<=3")
def _(t):
    return rank_rows(t.word_trials, L, [F.col("score_b").desc(), "row_id"]).where("rn <= 3").select("listener_id", "row_id", "rn")


@query("j13_distinct_union", "select word from word_vocab union select perceived_word from word_trials")
def _(t):
    return t.word_vocab.select("word").union(t.word_trials.select("perceived_word")).distinct()


FOLD = """(select listener_id, case when (rn-1)//5%2=0 then (rn-1)%5 else 4-(rn-1)%5 end fold from (select listener_id, row_number() over (order by round(avg(misheard),9), cast(concat('0x',substr(md5(concat('fold0:',listener_id::varchar)),1,8)) as bigint), listener_id) rn from word_trials group by listener_id))"""


@query("k01_stratified_folds", f"select listener_id, fold::int fold from {FOLD}")
def _(t):
    return sp.listener_folds(t.word_trials, 5)


@query("k02_group_folds", "select listener_id, ((row_number() over (order by count(*) desc, listener_id)-1)%5)::int fold from word_trials group by listener_id")
def _(t):
    return sp.listener_folds(t.word_trials, 5, stratify=False)


@query("k03_leave_one_out", "select listener_id, dense_rank() over (order by listener_id)-1 fold from (select distinct listener_id from word_trials)")
def _(t):
    return sp.leave_one_out(t.word_trials)


@query("k04_fold_summary", f"select fold::int fold, count(*) n_test, count(distinct w.listener_id) n_test_listeners, round(avg(misheard),6) test_rate, (select count(*) from word_trials)-count(*) n_train, (select count(distinct listener_id) from word_trials)-count(distinct w.listener_id) n_train_listeners from word_trials w join {FOLD} f on f.listener_id=w.listener_id group by all")
def _(t):
    return rnd(sp.fold_summary(t.word_trials, sp.listener_folds(t.word_trials, 5)))


@query("k05_leakage_guard", f"select listener_id, count(distinct fold) n_folds from (select w.listener_id, f.fold from word_trials w join {FOLD} f on f.listener_id=w.listener_id) group by all having count(distinct fold)>1")
def _(t):
    return sp.leaked_listeners(t.word_trials.join(sp.listener_folds(t.word_trials, 5), "listener_id"))


@query("k06_prior_leaks", f"select distinct c.listener_id from counts c join {FOLD} f on f.listener_id=c.listener_id where f.fold=0")
def _(t):
    folds = sp.listener_folds(t.word_trials, 5)
    return sp.prior_leaks(cf.prior_contributors(qc.counts(t)), folds.where("fold = 0"))


@query("k07_leaky_split")
def _(t):
    return sp.leaked_listeners(sp.leaky_folds(t.word_trials, 5))


@query("k08_calibration_holdout", "select listener_id, rn<=least(greatest(round_even(0.25::double*nn,0),1),nn-1) held_out from (select listener_id, row_number() over (order by cast(concat('0x',substr(md5(concat('fold0:',listener_id::varchar)),1,8)) as bigint), listener_id) rn, count(*) over () nn from (select distinct listener_id from word_trials))")
def _(t):
    return sp.calibration_holdout(t.word_trials)


@query("k09_predicted_once", "select row_id, 0::bigint n from word_trials where score=0")
def _(t):
    return sp.prediction_gaps(t.word_trials, t.word_trials.where("score > 0"))


@query("k10_prior_per_fold", f"""select g.fold::int fold, g.position, g.target, g.perceived, sum(c.n)::bigint n from (select distinct fold, position, target, perceived from counts cross join (select distinct fold from {FOLD})) g
  join (select c.*, f.fold from counts c join {FOLD} f on f.listener_id=c.listener_id) c on c.position=g.position and c.target=g.target and c.perceived=g.perceived and c.fold<>g.fold group by all""")
def _(t):
    return sp.fold_counts(qc.counts(t), sp.listener_folds(t.word_trials, 5))


def strata(t):
    return qh.summary(t).select("listener_id", F.coalesce("severity_4group", F.lit("unknown")).alias("stratum"))


@query("n01_mishear_rates", "select coalesce(severity_4group,'unknown') stratum, count(distinct w.listener_id) n_listeners, round(avg(misheard),6) mishear_rate from word_trials w join hear h on h.listener_id=w.listener_id group by all")
def _(t):
    return rnd(cohort.by_stratum(t.word_trials, strata(t)))


@query("n02_syllable_accuracy", "select coalesce(severity_4group,'unknown') stratum, round(avg(a),6) accuracy from (select listener_id, avg(case when trial_error='correct' then 1.0 else 0 end) a from trial_err group by all) e join hear h on h.listener_id=e.listener_id group by all")
def _(t):
    return rnd(cohort.syllable_accuracy(qc.scored(t), strata(t)))


@query("n03_lexical_trap_rate", "select count(*) n_errored, round(avg(case when perceived_word in (select word from word_vocab) then 1.0 else 0 end),6) lexical_trap_rate from word_trials where n_segment_errors>0")
def _(t):
    return rnd(cohort.lexical_trap_rate(t.word_trials, t.word_vocab))


@query("n04_cohort_summary", "select a.*, b.* from (select count(*) n_word_trials, count(distinct listener_id) n_listeners, round(avg(misheard),6) mishear_rate from word_trials) a cross join (select count(*) n_errored, round(avg(case when perceived_word in (select word from word_vocab) then 1.0 else 0 end),6) lexical_trap_rate from word_trials where n_segment_errors>0) b")
def _(t):
    return rnd(cohort.summary(t.word_trials, t.word_vocab))


def ap(score):
    return f"""(select sum(pos/tp*(tp-cp+pos)/(tp+tn-cn+pos+neg)) from (select *, sum(pos+neg) over (order by s) cn, sum(pos) over (order by s) cp, sum(pos) over ()::double tp, sum(neg) over ()::double tn
  from (select s, sum(misheard) pos, sum(1-misheard) neg from (select misheard, {score} s from word_trials) group by s)))"""


@query("n05_signal_ceiling", f"""select count(*) n_trials, round(avg(misheard),6) prevalence, count(distinct n_segment_errors*100+n_syll) n_cells, round(avg(case when n_segment_errors=0 then misheard end),6) p_misheard_given_zero_errors,
  round({ap('avg(misheard) over (partition by n_segment_errors, n_syll)')},6) oracle_pr_auc, round({ap('n_syll')},6) word_length_pr_auc from word_trials""")
def _(t):
    return rnd(cohort.signal_ceiling(t.word_trials))


@query("n06_form_influence", """select count(*) n_cells_with_comparable_forms, round(avg(sd),6) mean_rate_sd_across_forms, round(max(sd),6) max_rate_sd_across_forms from (select n_segment_errors, n_syll, stddev_pop(r) sd from
  (select n_segment_errors, n_syll, perceived_word, avg(misheard) r from word_trials group by all having count(*)>=5) group by all having count(*)>=2)""")
def _(t):
    return rnd(cohort.form_influence(t.word_trials))


@query("a01_alignment_counts")
def _(t):
    return asr.edit_counts(asr.normalised(t.utterances), "ref_words", "hyp_words", "w_", ["utt_id"])


@query("a02_error_rates")
def _(t):
    return rnd(asr.evaluate_pairs(t.utterances, ["utt_id"]))


@query("a03_corpus_metrics")
def _(t):
    return rnd(asr.corpus_metrics(asr.evaluate_pairs(t.utterances, ["utt_id", "speaker_id", "duration_s", "runtime_s"]), []))


@query("a04_first_per_speaker", "select utt_id, speaker_id from (select utt_id, speaker_id, row_number() over (partition by speaker_id order by utt_id) rn from utterances) where rn=1 order by utt_id limit 5")
def _(t):
    return asr.first_per_speaker(t.utterances, 5).select("utt_id", "speaker_id")


TIMING = """select media_id, tok_idx, unnest(list_filter([case when end_s>dur+0.5 then 'past_end' end, case when start_s<ps then 'start_before_previous' end, case when start_s<pe-1e-6 then 'overlap' end], lambda x: x is not null)) problem
  from (select *, lag(start_s) over w ps, lag(end_s) over w pe, max(end_s) over (partition by media_id)-0.6 dur from tokens window w as (partition by media_id order by tok_idx))"""


def problems(t):
    dur = t.tokens.groupBy("media_id").agg((F.max("end_s") - 0.6).alias("duration_s"))
    return asr.timing_problems(t.tokens, dur)


@query("a05_timing_problems", TIMING)
def _(t):
    return problems(t)


@query("a03_corpus_counts", f"""select (select count(*) from tokens) n_tokens, (select count(confidence) from tokens) n_tokens_with_confidence,
  count(distinct media_id) utterances_with_timing_problems, count(*) n_timing_problems from ({TIMING})""")
def _(t):
    return asr.corpus_counts(t.tokens, problems(t))

