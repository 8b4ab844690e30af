"""Caption selection (P), cues and exports (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonrisk.operators import cues as cu
from phonrisk.operators import metrics as mt
from phonrisk.operators import policy as po
from phonrisk.session import durable, scratch_dir
from phonrisk.suite.q_features import evidence, rnd
from phonrisk.suite.q_metrics import DRAWN, B
from phonrisk.suite.registry import query

UNC = "coalesce(confidence<0.3,false)"
BUD = f"""select *, case when rn<=round_even(0.2::double*nn,0) then 'shown_high_risk' when {UNC} then 'shown_low_asr_confidence' else 'hidden' end decision from (select *,
  row_number() over (partition by media_id order by listener_risk desc, start_s, tok_idx) rn, count(*) over (partition by media_id) nn from tokens)"""


@query("p01_full_policy", "select media_id, tok_idx, 'shown_full' decision, 'full' as policy from tokens")
def _(t):
    return po.full_policy(t.tokens).select("media_id", "tok_idx", "decision", "policy")


@query("p02_threshold_policy", "select media_id, tok_idx, case when listener_risk>0.6 then 'shown_high_risk' else 'hidden' end decision, 'threshold(tau=0.60)' as policy from tokens")
def _(t):
    return po.threshold_policy(t.tokens, 0.6).select("media_id", "tok_idx", "decision", "policy")


@query("p03_budget_policy", f"select media_id, tok_idx, case when rn<=round_even(0.2::double*nn,0) then 'shown_high_risk' else 'hidden' end decision from ({BUD})")
def _(t):
    return po.budget_policy(t.tokens, 0.2).select("media_id", "tok_idx", "decision")


@query("p04_recogniser_floor", f"select media_id, tok_idx, decision from ({BUD})")
def _(t):
    return po.budget_policy(t.tokens, 0.2, 0.3).select("media_id", "tok_idx", "decision")


@query("p05_caption_ratio", f"select media_id, round(avg(case when decision<>'hidden' then 1.0 else 0 end),6) caption_ratio, round(1-avg(case when decision<>'hidden' then 1.0 else 0 end),6) caption_reduction_ratio from ({BUD}) group by all")
def _(t):
    return rnd(po.caption_ratio(po.budget_policy(t.tokens, 0.2, 0.3), ["media_id"]))


@query("p06_listener_thresholds", "select listener_id, round(quantile_cont(score,0.8),6) tau from word_trials group by all")
def _(t):
    return rnd(po.thresholds(t.word_trials, ["listener_id"], 0.2))


@query("p07_global_threshold", "select round(quantile_cont(score_b,0.7),6) tau from word_trials")
def _(t):
    return rnd(po.thresholds(t.word_trials, [], 0.3, "score_b"))


def u(key):
    return f"cast(concat('0x',substr(md5({key}),1,8)) as bigint)/4294967296.0::double"


TIE = u("concat('tie0:',row_id::varchar)")


@query("p08_budget_selection", f"select row_id, rn<=round_even(0.3::double*nn,0) selected from (select row_id, row_number() over (partition by listener_id order by score desc, {TIE}, row_id) rn, count(*) over (partition by listener_id) nn from word_trials)")
def _(t):
    return po.ranked_for_budget(t.word_trials, ["listener_id"]).select("row_id", po.within(0.3).alias("selected"))


@query("p08_pooled_selection", f"select row_id, rn<=round_even(0.3::double*nn,0) selected from (select row_id, row_number() over (order by score desc, {TIE}, row_id) rn, count(*) over () nn from word_trials)")
def _(t):
    return po.ranked_for_budget(t.word_trials, []).select("row_id", po.within(0.3).alias("selected"))


@query("p09_exact_count", "select row_id from (select row_id, row_number() over (order by score desc, row_id) rn from word_trials) where rn<=777")
def _(t):
    return po.ranked_for_budget(t.word_trials, [], seed=None).where("rn <= 777").select("row_id")


@query("p10_boundary_ties", """select listener_id, case when cut<=0 or cut>=nn then 0 else count(*) filter (where score=bs) end n_ties from (select *, max(case when rn=cut then score end) over (partition by listener_id) bs
  from (select listener_id, score, row_number() over (partition by listener_id order by score desc, row_id) rn, count(*) over (partition by listener_id) nn, round_even(0.2::double*count(*) over (partition by listener_id),0) cut from word_trials)) group by listener_id, cut, nn""")
def _(t):
    return po.boundary_ties(t.word_trials, ["listener_id"], 0.2)


SEL = f"(select *, row_number() over (partition by listener_id order by score desc, {TIE}, row_id) rn, count(*) over (partition by listener_id) nn from word_trials)"


@query("p11_listener_recall", f"select listener_id, round(sum(case when rn<=round_even(0.3::double*nn,0) then misheard else 0 end)::double/nullif(sum(misheard),0),6) recall from {SEL} group by all")
def _(t):
    r = po.ranked_for_budget(t.word_trials, ["listener_id"])
    return rnd(po.listener_recall(r, po.within(0.3), ["listener_id"]))


PTS = """select {k} budget, round(sum(shown)/sum(n),6) achieved_ratio, round(1-sum(shown)/sum(n),6) caption_reduction_ratio, round(sum(hits)/sum(np),6) misheard_recall, round(sum(hits)/sum(shown),6) as precision,
  round((sum(np)-sum(hits))/sum(n),6) missed_rate, sum(n)::bigint n_words, sum(np)::bigint n_misheard, round(min(hits/nullif(np,0)),6) recall_min, round(quantile_cont(hits/nullif(np,0),0.5),6) recall_median, round(max(hits/nullif(np,0)),6) recall_max,
  round(quantile_cont(hits/nullif(np,0),0.25),6) recall_q25, round(avg(case when np=0 then null when hits/np<0.05 then 1.0 else 0 end),6) frac_near_zero
  from (select {k} budget, listener_id, count(*)::double n, sum(misheard)::double np, count(*) filter (where {sel})::double shown, sum(case when {sel} then misheard else 0 end)::double hits from {src} group by all) group by all"""
IN = "rn<=round_even(budget*nn,0)"
BUDS = "(values (0.1::double),(0.2::double),(0.3::double),(0.4::double),(0.5::double)) bb(budget)"


@query("p12_budget_point", PTS.format(k="", sel="rn<=round_even(0.2::double*nn,0)", src=f"(select *, 0.2::double budget from {SEL})"))
def _(t):
    return rnd(po.frontier(t.word_trials, [], budgets=(0.2,)))


@query("p12_recall_interval", f"""select 0.2::double budget, round(quantile_cont(v,0.025),6) recall_lo, round(quantile_cont(v,0.975),6) recall_hi, count(v) n_valid, count(*) n_resamples from (
  select b, sum(w*hits)/sum(w*np) v from ({DRAWN}) d join (select listener_id, sum(case when rn<=round_even(0.2::double*nn,0) then misheard else 0 end)::double hits, sum(misheard) np from {SEL} group by all) p
  on p.listener_id=d.listener_id group by b)""")
def _(t):
    totals = po.listener_totals(po.ranked_for_budget(t.word_trials, ["listener_id"]), {"b0": po.within(0.2)}, ["listener_id"])
    return rnd(po.recall_intervals(totals, {"b0": 0.2}, [], mt.draws(t.word_trials, B)))


@query("p13_frontier", PTS.format(k="seed,", sel=IN, src=f"(select * from (select *, row_number() over (partition by seed, listener_id order by score desc, {TIE}, row_id) rn, count(*) over (partition by seed, listener_id) nn from word_trials) cross join {BUDS})"))
def _(t):
    return rnd(po.frontier(t.word_trials, ["seed"]))


STRAT = f"""(select row_id, listener_id, misheard, 'random' strategy, {u("concat('random0:',row_id::varchar)")} ss from word_trials union all
  select row_id, listener_id, misheard, 'word_length', (length(word)-min(length(word)) over ())::double/(max(length(word)) over ()-min(length(word)) over ()) from word_trials union all select row_id, listener_id, misheard, 'model', score from word_trials)"""


@query("p14_strategies", PTS.format(k="strategy,", sel=IN, src=f"(select * from (select *, row_number() over (partition by strategy, listener_id order by ss desc, {TIE}, row_id) rn, count(*) over (partition by strategy, listener_id) nn from {STRAT}) cross join {BUDS})"))
def _(t):
    return rnd(po.frontier(po.strategy_scores(t.word_trials), ["strategy"], score="strategy_score"))


@query("p15_global_vs_personal", PTS.format(k="mode,", sel="rn<=round_even(0.2::double*nn,0)", src="""(select *, 0.2::double budget, 'global' as mode, row_number() over (order by score desc, row_id) rn, count(*) over () nn from word_trials
  union all select *, 0.2::double, 'personalized', row_number() over (partition by listener_id order by score desc, row_id) rn, count(*) over (partition by listener_id) nn from word_trials)"""))
def _(t):
    return rnd(po.compare_thresholds(t.word_trials, 0.2))


@query("p16_pareto", "select budget, round(achieved_ratio,4) achieved_ratio, round(caption_reduction_ratio,4) caption_reduction_ratio, round(misheard_recall,4) misheard_recall, round(precision,4) as precision, round(missed_rate,4) missed_rate, round(recall_min,4) recall_min, round(recall_median,4) recall_median, round(recall_max,4) recall_max from (" +
       PTS.format(k="", sel=IN, src=f"(select * from {SEL} cross join {BUDS})") + ")")
def _(t):
    return po.pareto(rnd(po.frontier(t.word_trials, [])))


RATE = """select seed, tau, coalesce(least(1.0::double, greatest(0.0::double, 0.2::double-avg(case when score>tau then 1.0::double else 0 end))/nullif(avg(case when abs(score-tau)<=1e-12 then 1.0::double else 0 end),0)),0) f
  from (select *, quantile_cont(score,0.8) over (partition by seed) tau from word_trials) group by seed, tau"""


@query("p17_rate_threshold", f"select seed, round(tau,6) tau, round(f,6) tie_pass_fraction from ({RATE})")
def _(t):
    return rnd(po.rate_threshold(t.word_trials, ["seed"], 0.2))


@query("p18_tie_split", f"select w.row_id, case when abs(score-tau)<=1e-12 then {u('concat(chr(116),chr(105),chr(101),chr(58),listener_id::varchar,chr(58),word)')} < f else score>tau end selected from word_trials w join ({RATE}) r on r.seed=w.seed")
def _(t):
    tau = po.rate_threshold(t.word_trials, ["seed"], 0.2)
    return t.word_trials.join(F.broadcast(tau), "seed").select("row_id", po.passes("score", "listener_id", "word").alias("selected"))  # one row a seed


@query("p19_threshold_grid", """select threshold, round(sum(shown)/sum(n),6) caption_rate, round(sum(hits)/sum(np),6) misheard_recall, round(sum(hits)/nullif(sum(shown),0),6) as precision, round(avg(hits/nullif(np,0)),6) recall_mean_listener,
  round(quantile_cont(hits/nullif(np,0),0.5),6) recall_median_listener, round(min(hits/nullif(np,0)),6) recall_worst_listener, round(stddev_samp(shown/n),6) caption_rate_sd_listener, round(avg(case when shown/n<0.02 then 1.0 else 0 end),6) frac_listeners_near_zero_captions,
  round(2*(sum(hits)/sum(shown))*(sum(hits)/sum(np))/(sum(hits)/sum(shown)+sum(hits)/sum(np)),6) f1
  from (select threshold, listener_id, count(*)::double n, sum(misheard)::double np, count(*) filter (where score>=threshold)::double shown, sum(case when score>=threshold then misheard else 0 end)::double hits
   from word_trials cross join (values (0.3::double),(0.5::double),(0.7::double),(0.9::double)) x(threshold) group by all) group by all""")
def _(t):
    return rnd(po.threshold_points(t.word_trials, (0.3, 0.5, 0.7, 0.9), []))


@query("p20_budget_metrics", PTS.format(k="seed,", sel=IN, src=f"(select *, 0.2::double budget from (select *, row_number() over (partition by seed, listener_id order by score_b desc, {TIE}, row_id) rn, count(*) over (partition by seed, listener_id) nn from word_trials))").replace("select seed, budget,", "select seed, budget,", 1))
def _(t):
    return rnd(po.frontier(t.word_trials, ["seed"], budgets=(0.2,), score="score_b"))


@query("p21_attach_risk", """select t.media_id, t.tok_idx, case when len(regexp_extract_all(t.text,'[가-힣]'))=0 then 'no Hangul' when x.x_r_phon is null then 'no estimate' end reason, round(coalesce(x.x_r_phon,0),6) risk
  from tokens t left join xblock x on x.listener_id=t.listener_id and x.word=t.text""")
def _(t):
    from phonrisk.operators.features import independence_risk
    risks = evidence(t).select("listener_id", "word", independence_risk().alias("risk"))
    return rnd(po.attach_risk(t.tokens, risks).select("media_id", "tok_idx", "reason", "risk"))


@query("p22_explanations", """select listener_id, word, rank, position, symbol target, round(p,6) p_correct, n n_observations, n=0 prior_only, backed_off from (select *,
  row_number() over (partition by listener_id, word order by p, si, case position when 'onset' then 0 when 'nucleus' then 1 else 2 end) rank from evid) where rank<=3""")
def _(t):
    from phonrisk.operators.features import explain
    return rnd(explain(evidence(t), ["listener_id", "word"]))


@query("p23_media_summary", f"select media_id, count(*) n_words, count(*) filter (where decision<>'hidden') n_shown, round(avg(case when decision<>'hidden' then 1.0 else 0 end),6) caption_ratio, round(avg(listener_risk),6) mean_risk, max(end_s) duration_s, count(confidence) n_with_confidence from ({BUD}) group by all")
def _(t):
    return rnd(po.media_summary(po.budget_policy(t.tokens, 0.2, 0.3)), "duration_s")


CUES = f"""select media_id, row_number() over (partition by media_id order by rn0) cue_idx, start_s, max_risk, texts, risks, e0,
  case when e0 > lead(start_s) over (partition by media_id order by rn0) then greatest(start_s, lead(start_s) over (partition by media_id order by rn0)-0.001::double) else e0 end end_s from (
  select media_id, min(r) rn0, arg_min(start_s, r) start_s, greatest(arg_max(end_s, r), arg_min(start_s, r)+0.4::double) e0, max(listener_risk) max_risk, list(text order by r) texts, list(listener_risk order by r) risks from (
   select *, (row_number() over (partition by media_id, run order by r)-1)//8 chunk from (select *, sum(case when pe is null or start_s-pe>0.35::double then 1 else 0 end) over (partition by media_id order by r rows unbounded preceding) run from (
    select *, lag(end_s) over (partition by media_id order by r) pe from (select *, row_number() over (partition by media_id order by start_s, end_s, tok_idx) r from tokens where listener_risk>0.4))))
   group by media_id, run, chunk)"""


def shown(t):
    return po.threshold_policy(t.tokens, 0.4).where(po.is_shown())


@query("u01_cues", f"select media_id, cue_idx, start_s, array_to_string(texts,' ') line, len(texts) n_words, max_risk from ({CUES})")
def _(t):
    return cu.build_cues(shown(t)).select("media_id", "cue_idx", "start_s", cu.cue_line(F.col("words")).alias("line"), F.size("words").alias("n_words"), "max_risk")


@query("u02_cue_times", f"select media_id, cue_idx, round(start_s,6) start_s, round(end_s,6) end_s from ({CUES})")
def _(t):
    return rnd(cu.build_cues(shown(t)).select("media_id", "cue_idx", "start_s", "end_s"))


@query("u03_cue_validation", f"select media_id, cue_idx, case when end_s<=start_s then 'no_duration' else 'overlap' end reason from (select *, lag(end_s) over (partition by media_id order by cue_idx) pe from ({CUES})) where end_s<=start_s or start_s<pe")
def _(t):
    return cu.bad_cues(cu.build_cues(shown(t))).select("media_id", "cue_idx", "reason")


def _ms(x):
    m = f"cast(round_even({x}*1000,0) as bigint)"
    return f"printf('%02d:%02d:%02d,%03d', {m}//3600000, {m}//60000%60, {m}//1000%60, {m}%1000)"


def _cs(x):
    m = f"cast(round_even({x}*100,0) as bigint)"
    return f"printf('%d:%02d:%02d.%02d', {m}//360000, {m}//6000%60, {m}//100%60, {m}%100)"


@query("u04_srt", f"select media_id, cue_idx, concat(cue_idx::varchar, chr(10), {_ms('start_s')}, ' --> ', {_ms('end_s')}, chr(10), array_to_string(texts,' '), chr(10), chr(10)) block from ({CUES})")
def _(t):
    return cu.srt_blocks(cu.build_cues(shown(t))).select("media_id", "cue_idx", "block")


U05 = f"""select media_id, cue_idx, concat('Dialogue: 0,', {_cs('start_s')}, ',', {_cs('end_s')}, ',Default,,0,0,0,,', array_to_string(list_transform(texts, lambda x, i: concat('{{\\c', case when risks[i]<0.35 then '&H00FFFFFF' when risks[i]<0.6 then '&H0080D4FF' else '&H004040FF' end, '}}', x)),' ')) line from ({CUES})"""
HEADER = cu.ASS_HEADER.split("\n")


@query("u05_ass", U05)
def _(t):
    return cu.ass_lines(cu.build_cues(shown(t))).select("media_id", "cue_idx", "line")


@query("u05_ass_file", f"""select media_id, line_no, line from (select distinct media_id from ({CUES})) cross join
  (select unnest(range(1, {len(HEADER) + 1})) line_no, unnest([{', '.join("'" + h + "'" for h in HEADER)}]) line) union all select media_id, {len(HEADER)} + cue_idx, line from ({U05})""")
def _(t):
    return cu.ass_file(durable(cu.build_cues(shown(t))))


S19 = f"""select s.media_id, s.sha srt_sha256, a.sha ass_sha256, w.n n_json_lines from
  (select media_id, sha256(string_agg(concat(cue_idx::varchar, chr(10), {_ms('start_s')}, ' --> ', {_ms('end_s')}, chr(10), array_to_string(texts,' '), chr(10), chr(10)), '' order by cue_idx)) sha from ({CUES}) group by media_id) s
  join (select media_id, sha256(concat('{"', chr(10), '".join(HEADER)}', chr(10), string_agg(concat(line, chr(10)), '' order by cue_idx))) sha from ({U05}) group by media_id) a on a.media_id=s.media_id
  join (select media_id, count(*)+1 n from ({BUD}) group by media_id) w on w.media_id=s.media_id"""


@query("s19_caption_files", S19)
def _(t):
    from phonrisk.sources.caption_files import write_files

    root, words = scratch_dir(t.spark, "captions"), durable(po.budget_policy(t.tokens, 0.2, 0.3))
    cues = durable(cu.build_cues(shown(t)))
    line = F.concat("line", F.lit("\n"))
    write_files(cu.srt_blocks(cues), f"{root}/srt", "srt", media="media_id", order="cue_idx", text="block")
    write_files(cu.ass_file(cues).withColumn("line", line), f"{root}/ass", "ass", media="media_id", order="line_no", text="line")
    write_files(cu.json_rows(words, po.media_summary(words)).withColumn("json", F.concat("json", F.lit("\n"))), f"{root}/json", "jsonl", media="media_id", order="tok_idx", text="json")
    media = F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("long").alias("media_id")
    read = lambda kind: t.spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(f"{root}/{kind.removesuffix('l')}")
    sha = lambda kind: read(kind).select(media, F.sha2("content", 256).alias(f"{kind}_sha256"))
    lines = read("jsonl").select(media, (F.size(F.split(F.col("content").cast("string"), "\n")) - 1).cast("long").alias("n_json_lines"))
    return sha("srt").join(sha("ass"), "media_id").join(lines, "media_id")


@query("u06_json_export", f"""select media_id, -1::bigint tok_idx, json_extract(j,'$.n_words')::bigint n_words, json_extract(j,'$.n_shown')::bigint n_shown, null::varchar as text, null::varchar decision from (select media_id, json_object('n_words', count(*), 'n_shown', count(*) filter (where decision<>'hidden')) j from ({BUD}) group by media_id)
  union all select media_id, tok_idx, null, null, text, decision from ({BUD})""")
def _(t):
    words = po.budget_policy(t.tokens, 0.2, 0.3)
    rows = cu.json_rows(words, po.media_summary(words))
    j = F.from_json("json", "n_words bigint, n_shown bigint, text string, decision string")
    return rows.select("media_id", "tok_idx", j.alias("j")).select("media_id", "tok_idx", "j.*")
