"""Shared sub-queries for the DuckDB oracles, kept apart from the Spark code they check."""

from __future__ import annotations

from phonrisk.functions import hangul as hg


def _values(rows: list[tuple]) -> str:
    return ",".join("(" + ",".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _targets() -> list[tuple]:
    out = []
    for pos, alphabet in hg.ALPHABET.items():
        for i, s in enumerate(alphabet):
            out.append((
                pos, i, s,
                hg.class_of(hg.MANNER, s) if pos == "onset" else None,
                hg.class_of(hg.PHONATION, s) if pos == "onset" else None,
                hg.class_of(hg.PLACE, s) if pos == "onset" else None,
                hg.class_of(hg.SHAPE, s) if pos == "nucleus" else None,
                (1 if s in hg.ROUNDED else 0) if pos == "nucleus" else None,
                (hg.class_of(hg.CODA_SURFACE, s) or "-") if pos == "coda" else None,
                (1 if s in hg.CODA_CLUSTERS else 0) if pos == "coda" else None,
            ))
    return out


def syl_parts(ch: str) -> str:
    return (f"substr('{hg.ONSETS}', cast((unicode({ch})-44032)//588+1 as int), 1) onset, "
            f"substr('{hg.NUCLEI}', cast((unicode({ch})-44032)%588//28+1 as int), 1) nucleus, "
            f"substr('{hg.CODAS}', cast((unicode({ch})-44032)%28+1 as int), 1) coda")


CTES = {
    "dim_target": f"select * from (values {_values(_targets())}) t(position, idx, symbol, manner, phonation, place, shape, rounded, surface, is_cluster)",
    "dim_perceived": "select position, idx, symbol, coalesce(manner, shape, surface) cls from dim_target union all select distinct position, count(*) over (partition by position) idx, '?' symbol, null cls from dim_target",
    "dim_cls": "select position, idx, symbol, coalesce(manner, shape, surface) cls from dim_target",
    "scored": f"""
select trial_id, listener_id, condition, target, response, quality, rs,
  substr('{hg.ONSETS}', cast((unicode(target)-44032)//588+1 as int), 1) t_o,
  substr('{hg.NUCLEI}', cast((unicode(target)-44032)%588//28+1 as int), 1) t_n,
  substr('{hg.CODAS}', cast((unicode(target)-44032)%28+1 as int), 1) t_c,
  case when rs is null then '?' else substr('{hg.ONSETS}', cast((unicode(rs)-44032)//588+1 as int), 1) end r_o,
  case when rs is null then '?' else substr('{hg.NUCLEI}', cast((unicode(rs)-44032)%588//28+1 as int), 1) end r_n,
  case when rs is null then '?' else substr('{hg.CODAS}', cast((unicode(rs)-44032)%28+1 as int), 1) end r_c
from (select *, case when quality in ('ok','multi_syllable') then found[1] end rs
  from (select *, case when stripped in ('','?','??','-','x','X','모름','못들음','무응답') then 'blank'
      when len(found)=0 then 'non_hangul' when len(found)>1 then 'multi_syllable' else 'ok' end quality
    from (select *, nfc_normalize(trim(response)) stripped, regexp_extract_all(nfc_normalize(trim(response)), '[가-힣]') found from calib_trials)))""",
    "obs": """
select trial_id, listener_id, condition, position, target, perceived,
  case when perceived='?' then 'no_response' when target=perceived then 'correct'
    when position='coda' and target<>'-' and perceived='-' then 'omission'
    when position='coda' and target='-' then 'addition'
    when position='onset' and target<>'ㅇ' and perceived='ㅇ' then 'omission'
    when position='onset' and target='ㅇ' then 'addition' else 'substitution' end error_type
from (select trial_id, listener_id, condition, 'onset' as position, t_o target, r_o perceived from scored
  union all select trial_id, listener_id, condition, 'nucleus', t_n, r_n from scored
  union all select trial_id, listener_id, condition, 'coda', t_c, r_c from scored)""",
    "trial_err": """
select trial_id, any_value(listener_id) listener_id, case when count(*) filter (where error_type='no_response')=3 then 'no_response'
  when count(*) filter (where error_type<>'correct')=0 then 'correct'
  when count(*) filter (where error_type<>'correct')>1 then 'compound'
  else max(case when error_type<>'correct' then concat(position,'_error') end) end trial_error
from obs group by trial_id""",
    "counts": "select listener_id, position, target, perceived, count(*) n from obs group by all",
    "cal_listeners": "select distinct listener_id from calib_trials",
    "dense": """
select l.listener_id, t.position, t.symbol target, t.idx t_idx, p.symbol perceived, p.idx p_idx, coalesce(c.n,0) n,
  sum(coalesce(c.n,0)) over (partition by l.listener_id, t.position, t.symbol) big_n,
  count(*) over (partition by l.listener_id, t.position, t.symbol) k
from cal_listeners l cross join dim_target t join dim_perceived p on p.position=t.position
left join counts c on c.listener_id=l.listener_id and c.position=t.position and c.target=t.symbol and c.perceived=p.symbol""",
    "post": "select *, (n + 1.0::double/k)/(big_n+1) p from dense",
    "diag": "select listener_id, position, target, t_idx, big_n, p from post where target=perceived",
    "group_prior": "select position, target, perceived, p_idx, (n + 1.0::double/k)/(big_n+1) p from (select *, sum(n) over (partition by position, target) big_n from (select position, target, perceived, p_idx, k, sum(n) n from dense group by all))",
    "shrunk": "select d.*, (d.n + 5.0::double*g.p)/(d.big_n+5) ps from dense d join group_prior g on g.position=d.position and g.target=d.target and g.perceived=d.perceived",
    "phon_vocab": f"""
select word, si, position, case position when 'onset' then onset when 'nucleus' then nucleus else coda end symbol
from (select word, si, {syl_parts("ch")} from (select word, unnest(range(1, len(syl)+1)) si, unnest(syl) ch from
   (select word, regexp_extract_all(word, '[가-힣]') syl from (select distinct word from word_vocab))))
cross join (values ('onset'),('nucleus'),('coda')) p(position)""",
    "pairs": "select distinct listener_id, word from word_trials",
    "evid": """
select q.listener_id, q.word, v.si, v.position, v.symbol,
  case when use_surface then s.p else d.p end p, case when use_surface then s.big_n else d.big_n end n,
  use_surface backed_off, d.p own_p, d.t_idx
from (select pairs.listener_id, pairs.word from pairs join cal_listeners using (listener_id)) q
join phon_vocab v on v.word=q.word
join diag d on d.listener_id=q.listener_id and d.position=v.position and d.target=v.symbol
join dim_target t on t.position=v.position and t.symbol=v.symbol
left join diag s on s.listener_id=q.listener_id and s.position='coda' and v.position='coda' and s.target=t.surface
cross join lateral (select v.position='coda' and d.big_n=0 and v.symbol<>'-' and t.surface<>v.symbol and coalesce(s.big_n,0)>0 use_surface) z""",
    "entropy": "select listener_id, position, target, -sum(p*ln(p)) h from post group by all",

    "thr": "select listener_id, ear, " + ", ".join(f"max(case when hz={h} and db_hl is not null and not no_response then db_hl end) t{h}" for h in (125, 250, 500, 1000, 2000, 3000, 4000, 6000, 8000)) + " from audiogram_points group by all",
    "ear_pi": """select p.listener_id, p.ear, m.pbmax, m.pk pbmax_level, case when m.pbmax<>0 then (m.pbmax - min(case when p.level_db_hl>m.pk then p.score_percent end))/m.pbmax end rollover_index
  from pi_points p join (select a.listener_id, a.ear, mx pbmax, min(level_db_hl) pk from pi_points a join (select listener_id, ear, max(score_percent) mx from pi_points group by all) b
    on a.listener_id=b.listener_id and a.ear=b.ear and a.score_percent=b.mx group by all) m on m.listener_id=p.listener_id and m.ear=p.ear group by p.listener_id, p.ear, m.pbmax, m.pk""",
    "ear_all": """select t.listener_id, t.ear, (t500+t1000+t2000+t4000)/4 pta, (t4000-t500)/3.0 slope, t4000, t6000, t8000, s.srt_db_hl, s.wrs_percent, p.pbmax, l.mcl_db_hl
  from thr t left join speech_scores s on s.listener_id=t.listener_id and s.ear=t.ear left join ear_pi p on p.listener_id=t.listener_id and p.ear=t.ear
  left join loudness l on l.listener_id=t.listener_id and l.ear=t.ear""",
    "hear": """select *, case when better_ear_pta is null then null when better_ear_pta<20 then 'normal' when better_ear_pta<35 then 'mild' when better_ear_pta<50 then 'moderate'
   when better_ear_pta<65 then 'moderately_severe' when better_ear_pta<80 then 'severe' when better_ear_pta<95 then 'profound' else 'complete' end severity_who,
   case when better_ear_pta is null then null when better_ear_pta<20 then 'normal' when better_ear_pta<35 then 'mild' when better_ear_pta<50 then 'moderate' else 'severe' end severity_4group
  from (select listener_id, max(case when ear='left' then pta end) pta_left, max(case when ear='right' then pta end) pta_right, min(pta) better_ear_pta, max(pta) worse_ear_pta,
   avg(slope) audiogram_slope, min(srt_db_hl) srt, max(wrs_percent) wrs, avg(wrs_percent) mean_wrs, max(pbmax) pbmax, min(mcl_db_hl) mcl,
   (sum(coalesce(t4000,0))+sum(coalesce(t6000,0))+sum(coalesce(t8000,0)))/nullif(count(t4000)+count(t6000)+count(t8000),0) high_freq_mean from ear_all group by all)""",
    "cls_of": "select position, symbol, concat('onset_manner_',manner) cls from dim_target where position='onset' union all select position, symbol, concat('onset_phon_',phonation) from dim_target where position='onset' union all select position, symbol, concat('nucleus_',shape) from dim_target where position='nucleus' union all select position, symbol, concat('coda_', case when surface='-' then 'none' else surface end) from dim_target where position='coda'",
    "glob_err": "select listener_id, 1-avg(case when target=perceived then 1.0::double else 0 end) g from obs group by all",
    "weak": "select d.listener_id, c.cls, coalesce(sum(case when d.big_n>0 then d.big_n*(1-d.p) end)/sum(case when d.big_n>0 then d.big_n end), any_value(g.g)) w from diag d join cls_of c on c.position=d.position and c.symbol=d.target join glob_err g on g.listener_id=d.listener_id group by all",
    "share": "select v.word, c.cls, count(*)*3.0::double/max(x.m) sh from phon_vocab v join (select word, count(*) m from phon_vocab group by word) x on x.word=v.word join cls_of c on c.position=v.position and c.symbol=v.symbol group by v.word, c.cls",
    "offd": """select p.listener_id, p.position, p.target, max(p.p) top1, sum(case when a.cls=b.cls then p.p else 0 end) same
  from post p join dim_cls a on a.position=p.position and a.symbol=p.target left join dim_cls b on b.position=p.position and b.symbol=p.perceived where p.target<>p.perceived group by all""",
    "evx": """select e.*, o.top1, o.same, h.h, d.big_n own_n, greatest(1-e.p,1e-6) mass, greatest(1-e.own_p,1e-6) own_mass from evid e
  join offd o on o.listener_id=e.listener_id and o.position=e.position and o.target=e.symbol
  join entropy h on h.listener_id=e.listener_id and h.position=e.position and h.target=e.symbol
  join diag d on d.listener_id=e.listener_id and d.position=e.position and d.target=e.symbol""",
    "xblock": """select listener_id, word, 1-exp(sum(ln(greatest(p,1e-6)))) x_r_phon, -sum(ln(greatest(p,1e-6))) x_neg_log_correct, min(p) x_min_p_correct, avg(p) x_mean_p_correct, 1-min(p) x_max_error,
  avg(case when position='onset' then p end) x_mean_p_onset, avg(case when position='nucleus' then p end) x_mean_p_nucleus, avg(case when position='coda' then p end) x_mean_p_coda,
  min(case when position='onset' then p end) x_min_p_onset, min(case when position='nucleus' then p end) x_min_p_nucleus, min(case when position='coda' then p end) x_min_p_coda,
  avg(h) x_mean_row_entropy, min(n)::double x_min_evidence, avg(n) x_mean_evidence, avg(case when n=0 then 1.0 else 0 end) x_frac_unobserved, avg(case when backed_off then 1.0 else 0 end) x_frac_backed_off
  from evx group by all""",
    "wblock": """select word, n::double w_n_syllables, 3.0*n w_n_phonemes, nc::double w_n_codas, nc::double/n w_coda_ratio, no::double w_n_distinct_onsets, cl::double w_has_cluster_coda,
  v::double/n w_struct_V, vc::double/n w_struct_VC, cv::double/n w_struct_CV, cvc::double/n w_struct_CVC
  from (select word, count(*) n, count(*) filter (where c<>'-') nc, count(distinct o) no, max(case when ch then 1 else 0 end) cl,
    count(*) filter (where o='ㅇ' and c='-') v, count(*) filter (where o='ㅇ' and c<>'-') vc, count(*) filter (where o<>'ㅇ' and c='-') cv, count(*) filter (where o<>'ㅇ' and c<>'-') cvc
    from (select v.word, si, max(case when v.position='onset' then v.symbol end) o, max(case when v.position='coda' then v.symbol end) c,
      bool_or(v.position='coda' and d.surface<>v.symbol) ch from phon_vocab v join dim_target d on d.position=v.position and d.symbol=v.symbol group by v.word, si) group by word)""",
}
