"""Hangul text jobs (H) and stimulus tables (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonrisk.functions import hangul as hg
from phonrisk.functions import text as tx
from phonrisk.operators import dims, stimuli, trials
from phonrisk.suite.oracle_ctes import syl_parts
from phonrisk.suite.registry import query, r6

CHARS = "select text_id, i-1 idx, substr(text, cast(i as int), 1) ch from (select text_id, text, unnest(range(1, length(text)+1)) i from texts)"
HAN = "unicode(ch) between 44032 and 55203"
STRUCT = "concat(case when onset<>'ㅇ' then 'C' else '' end, 'V', case when coda<>'-' then 'C' else '' end)"


def _chars(t):
    return t.texts.select("text_id", F.posexplode_outer(hg.chars(F.col("text"))).alias("idx", "ch"))


@query("h01_hangul_flags", f"select {HAN} is_hangul, count(*) n from ({CHARS}) group by all")
def _(t):
    return _chars(t).groupBy(hg.is_syllable(F.col("ch")).alias("is_hangul")).agg(F.count("*").alias("n"))


@query("h02_decompose", f"select trial_id, {syl_parts('target')} from calib_trials")
def _(t):
    c = F.col("target")
    return t.calib_trials.select("trial_id", hg.onset(c).alias("onset"), hg.nucleus(c).alias("nucleus"), hg.coda(c).alias("coda"))


@query("h03_compose", "select trial_id, target composed, cast(null as varchar) rejected from calib_trials")
def _(t):
    c = F.col("target")
    return t.calib_trials.select("trial_id", hg.compose(hg.onset(c), hg.nucleus(c), hg.coda(c)).alias("composed"),
                                 hg.compose(F.lit("q"), hg.nucleus(c), hg.coda(c)).alias("rejected"))


@query("h04_structure", f"select structure, count(*) n from (select {STRUCT} structure from (select {syl_parts('target')} from calib_trials)) group by all")
def _(t):
    return t.calib_trials.groupBy(hg.structure(F.col("target")).alias("structure")).agg(F.count("*").alias("n"))


@query("h05_explode_text", f"""select text_id, idx, ch, case when {HAN} then onset end onset, case when {HAN} then nucleus end nucleus,
  case when {HAN} then coda end coda from (select *, {syl_parts("case when " + HAN + " then ch else '가' end")} from ({CHARS}))""")
def _(t):
    c = F.col("ch")
    ok = hg.is_syllable(c)
    return _chars(t).select("text_id", "idx", "ch", F.when(ok, hg.onset(c)).alias("onset"),
                            F.when(ok, hg.nucleus(c)).alias("nucleus"), F.when(ok, hg.coda(c)).alias("coda"))


@query("h06_recompose_text", "select text_id, text from texts")
def _(t):
    rebuilt = F.transform(hg.chars(F.col("text")), lambda c: F.when(
        hg.is_syllable(c), hg.compose(hg.onset(c), hg.nucleus(c), hg.coda(c))).otherwise(c))
    return t.texts.select("text_id", F.array_join(rebuilt, "").alias("text"))


@query("h07_phoneme_rows", """select word, si-1 syllable_idx, position, symbol from phon_vocab""")
def _(t):
    syl = t.word_vocab.select("word").distinct().select("word", F.posexplode_outer(hg.syllables(F.col("word"))).alias("syllable_idx", "s"))
    return syl.select("word", "syllable_idx", F.inline_outer(hg.jamo(F.col("s")))).drop("idx")


@query("h08_categories", """select o.position, count(distinct d.symbol) n_target, count(distinct d.symbol)+1 n_perceived,
  (select count(*) from counts c where not exists (select 1 from dim_target x where x.position=c.position and x.symbol=c.target)) n_unknown
  from (select distinct position from obs) o join dim_target d on d.position=o.position group by all""")
def _(t):
    obs = trials.observations(trials.score_trials(t.calib_trials))
    cells = obs.select("position", "target").distinct()
    unknown = dims.unknown_categories(cells, "target").agg(F.count("*").alias("n_unknown"))
    sizes = dims.alphabet_sizes(t.spark).join(cells.select("position").distinct(), "position", "left_semi")
    return sizes.join(F.broadcast(unknown))  # one row


@query("h09_nfc", "select text_id, nfc_normalize(text) nfc from texts")
def _(t):
    # Decomposed by the fixture's own jamo, so composing must give the text back.
    return t.texts.select("text_id", tx.nfc(F.col("text")).alias("nfc"))


@query("h10_cue_text", r"select seq, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) cue from live_cues where text is not null")
def _(t):
    return t.live_cues.where("text is not null").select("seq", tx.cue_text(F.col("text")).alias("cue"))


@query("h11_recogniser_text", r"select utt_id, trim(regexp_replace(regexp_replace(replace(lower(reference),'_',' '), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) norm from utterances")
def _(t):
    return t.utterances.select("utt_id", tx.recogniser_text(F.col("reference")).alias("norm"))


@query("h12_hangul_only", "select media_id, tok_idx, array_to_string(regexp_extract_all(text,'[가-힣]'),'') hangul, len(regexp_extract_all(text,'[가-힣]'))>0 has_hangul from tokens")
def _(t):
    return t.tokens.select("media_id", "tok_idx", hg.hangul_only(F.col("text")).alias("hangul"), hg.has_hangul(F.col("text")).alias("has_hangul"))


@query("h13_neutralise_coda", "select c.target coda, d.surface, count(*) n from obs c join dim_target d on d.position='coda' and d.symbol=c.target where c.position='coda' group by all")
def _(t):
    coda = hg.coda(F.col("target"))
    return t.calib_trials.groupBy(coda.alias("coda"), hg.surface_coda(coda).alias("surface")).agg(F.count("*").alias("n"))


@query("h14_sound_classes", """select o.position, d.manner, d.phonation, d.place, d.shape, d.rounded, d.surface, d.is_cluster, count(*) n
  from obs o join dim_target d on d.position=o.position and d.symbol=o.target group by all""")
def _(t):
    obs = trials.observations(trials.score_trials(t.calib_trials)).groupBy("position", "target").count()
    d = dims.dim_target(t.spark).withColumnRenamed("symbol", "target")
    return (obs.join(F.broadcast(d), ["position", "target"])  # 68 rows
            .groupBy("position", "manner", "phonation", "place", "shape", F.col("rounded").cast("int").alias("rounded"),
                     "surface", F.col("is_cluster").cast("int").alias("is_cluster")).agg(F.sum("count").alias("n")))


@query("h15_class_completeness", "select count(*) n_used, count(*) filter (where manner is null and shape is null and surface is null) n_without_class from (select distinct position, target from obs) o left join dim_target d on d.position=o.position and d.symbol=o.target")
def _(t):
    used = trials.observations(trials.score_trials(t.calib_trials)).select("position", "target").distinct()
    d = dims.dim_target(t.spark).select("position", F.col("symbol").alias("target"), "classes")
    return used.join(F.broadcast(d), ["position", "target"], "left").agg(  # 68 rows
        F.count("*").alias("n_used"), F.sum(F.when(F.col("classes").isNull(), 1).otherwise(0)).alias("n_without_class"))


SIM = """select a.position, a.symbol target, b.symbol perceived, case when a.symbol=b.symbol then 1.0
  when a.position='onset' then ((case when a.manner=b.manner then 1 else 0 end)+(case when a.place=b.place then 1 else 0 end)+(case when a.phonation=b.phonation then 1 else 0 end))/3.0
  when a.position='nucleus' then ((case when a.shape=b.shape then 1 else 0 end)+(case when a.rounded=b.rounded then 1 else 0 end))/2.0
  when a.symbol='-' or b.symbol='-' then 0.0 when a.surface=b.surface then 1.0 else 0.25 end similarity
  from dim_target a join dim_target b on a.position=b.position union all select position, symbol, '?', 0.0 from dim_target"""


@query("h16_similarity", f"select c.listener_id, c.position, round(cast(sum(c.n*s.similarity) as double)/sum(c.n),6) mean_similarity from counts c join ({SIM}) s on s.position=c.position and s.target=c.target and s.perceived=c.perceived group by all")
def _(t):
    from phonrisk.operators.confusion import count_observations
    obs = trials.observations(trials.score_trials(t.calib_trials), "listener_id")
    s = dims.similarity(t.spark)
    return (count_observations(obs, ["listener_id"]).join(F.broadcast(s), ["position", "target", "perceived"])  # 1,654 rows
            .groupBy("listener_id", "position")
            .agg(r6(F.sum(F.col("n") * F.col("similarity")) / F.sum("n")).alias("mean_similarity")))


@query("h17_same_class", """select o.listener_id, o.position, count(*) n_substitutions, count(*) filter (where a.cls=b.cls) n_within_class
  from obs o join dim_cls a on a.position=o.position and a.symbol=o.target join dim_cls b on b.position=o.position and b.symbol=o.perceived
  where o.target<>o.perceived and o.perceived<>'?' group by all""")
def _(t):
    obs = trials.observations(trials.score_trials(t.calib_trials), "listener_id")
    p = F.col("position")
    same = hg.sound_class(p, F.col("target")) == hg.sound_class(p, F.col("perceived"))
    return (obs.where((F.col("target") != F.col("perceived")) & (F.col("perceived") != "?"))
            .groupBy("listener_id", "position").agg(F.count("*").alias("n_substitutions"), F.count_if(same).alias("n_within_class")))


ID = "case when o_orderkey % 7 = 0 then concat('bad id ',cast(o_orderkey as varchar(20))) when o_orderkey % 11 = 0 then concat('__agg',cast(o_orderkey as varchar(20)),'__') else concat('L',cast(o_custkey as varchar(20))) end"


@query("h18_identifiers", f"select count(*) n, count(*) filter (where regexp_matches(id,'^[A-Za-z0-9][A-Za-z0-9._-]{{0,63}}$')) n_valid, count(*) filter (where regexp_matches(id,'^__.+__$')) n_reserved from (select {ID} id from orders)")
def _(t):
    ids = t.orders.selectExpr(f"{ID} id")
    return ids.agg(F.count("*").alias("n"), F.count_if(tx.valid_identifier(F.col("id"))).alias("n_valid"),
                   F.count_if(tx.reserved_identifier(F.col("id"))).alias("n_reserved"))


SEC = "cast(o_orderkey as double)*1237.125/1000"


@query("h19_time_stamps", f"""select o_orderkey, printf('%02d:%02d:%02d,%03d', ms//3600000, ms//60000%60, ms//1000%60, ms%1000) srt,
  printf('%d:%02d:%02d.%02d', cs//360000, cs//6000%60, cs//100%60, cs%100) ass
  from (select o_orderkey, cast(round_even({SEC}*1000,0) as bigint) ms, cast(round_even({SEC}*100,0) as bigint) cs from orders)""")
def _(t):
    sec = F.expr(SEC)
    return t.orders.select("o_orderkey", tx.srt_stamp(sec).alias("srt"), tx.ass_stamp(sec).alias("ass"))


@query("h20_ass_escape_colour", r"""select row_id, replace(replace(replace(raw,'\','\\'),'{','\{'),'}','\}') escaped,
  case when score<0.35 then '&H00FFFFFF' when score<0.60 then '&H0080D4FF' else '&H004040FF' end colour
  from (select row_id, score, concat('{', word, '\', word, '}') raw from word_trials)""")
def _(t):
    raw = F.concat(F.lit("{"), F.col("word"), F.lit("\\"), F.col("word"), F.lit("}"))
    return t.word_trials.select("row_id", tx.ass_escape(raw).alias("escaped"), tx.risk_colour(F.col("score")).alias("colour"))


DUCK_DESIGN = "chr(cast(44032 + (i%19*21+i%21)*28 + case i%8 when 0 then 0 when 1 then 1 when 2 then 4 when 3 then 7 when 4 then 8 when 5 then 16 when 6 then 17 else 21 end as integer))"


@query("t01_balanced_catalog", f"""select cast(c.i as bigint) pos, c.syllable, printf('builtin-%04d', c.i) stimulus_id, count(t.trial_id) n_trials
  from (select range i, {DUCK_DESIGN.replace('i%', 'range%')} syllable from range(3192)) c left join calib_trials t on t.target=c.syllable group by all""")
def _(t):
    seen = t.calib_trials.groupBy(F.col("target").alias("syllable")).agg(F.count("*").alias("n"))
    cat = stimuli.balanced_catalog(t.spark).join(seen, "syllable", "left")
    return cat.select("pos", "syllable", "stimulus_id", F.coalesce("n", F.lit(0)).alias("n_trials"))


LISTENER_CAT = "select distinct listener_id, stimulus_id pos, target syllable from calib_trials"


def _catalogs(t):
    return t.calib_trials.select("listener_id", F.col("stimulus_id").alias("pos"), F.col("target").alias("syllable")).distinct()


COV = f"""select listener_id, position, symbol, count(*) n from (select listener_id, pos, position, case position when 'onset' then onset when 'nucleus' then nucleus else coda end symbol
  from (select listener_id, pos, {syl_parts('syllable')} from ({LISTENER_CAT})) cross join (values ('onset'),('nucleus'),('coda')) p(position)) group by all"""


@query("t02_catalog_coverage", COV)
def _(t):
    return stimuli.coverage(_catalogs(t), ["listener_id"])


@query("t03_balance_score", f"select listener_id, position, round(min(n)::double/max(n)*count(*)/(case any_value(position) when 'onset' then 19 when 'nucleus' then 21 else 8 end),6) balance from ({COV}) group by all")
def _(t):
    return stimuli.balance_score(_catalogs(t), ["listener_id"]).withColumn("balance", r6("balance"))


@query("t04_greedy_subset")
def _(t):
    return stimuli.greedy_subset(_catalogs(t), "listener_id", 12)


@query("t05_random_subset", """select v, word from (select v, word, row_number() over (order by h, v) rn from
  (select v, word, cast(concat('0x',substr(md5(concat('subset7:',cast(v as varchar))),1,8)) as bigint) h from word_vocab)) where rn<=50""")
def _(t):
    cat = t.word_vocab.select("v", "word")
    return stimuli.random_subset(cat, 50, 7, pos="v")


@query("t06_catalog_from_list", "select v, i-1 pos, substr(word, cast(i as int), 1) syllable from (select v, word, unnest(range(1,length(word)+1)) i from word_vocab) where i-1 < 2")
def _(t):
    return stimuli.head(stimuli.from_list(t.word_vocab, ["v"], "word"), 2)


@query("t07_reference_vocabulary", f"""with ref as (select v, n_syll, string_agg({DUCK_DESIGN.replace('i%', '((st+j)%3192)%')}, '' order by j) word from
  (select v, n_syll, st, unnest(range(0, n_syll)) j from (select v, n_syll, sum(n_syll) over (order by v)-n_syll st from
   (select range v, case when range<80 then 1 when range<260 then 2 when range<360 then 3 else 4 end n_syll from range(400)))) group by v, n_syll)
  select cast(r.v as int) v, r.n_syll, r.word, count(t.row_id) n_trials from ref r left join word_trials t on t.word=r.word group by all""")
def _(t):
    seen = t.word_trials.groupBy("word").agg(F.count("*").alias("n"))
    ref = stimuli.reference_vocabulary(t.spark)
    return seen.join(F.broadcast(ref), "word", "right").select("v", "n_syll", "word", F.coalesce("n", F.lit(0)).alias("n_trials"))
