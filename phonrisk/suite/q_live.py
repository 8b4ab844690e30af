"""Live cues (L): batch forms with oracles, and the same results from real streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonrisk.functions.text import hash32
from phonrisk.operators import confusion as cf
from phonrisk.session import scratch_dir
from phonrisk.streaming import live as lv
from phonrisk.suite import q_confusion as qc
from phonrisk.suite.q_cohort import REF
from phonrisk.suite.q_features import rnd
from phonrisk.suite.registry import query

DAYS = 7  # a delivery is what arrived within so many days


#: Results arrive up to 400 cues late, which is weeks where cues are few.
AGES = {"late": "30 days", "idle": "60 days"}


def _timed(t):
    return t.live_cues.withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def _deliveries(t, df, order, name, build, parts=3):
    """Deliver ``df`` in slices of ``order``, each as files of several tasks, and run the stream after each."""
    path, folder = scratch_dir(t.spark, name), scratch_dir(t.spark, name)
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    number = F.least(F.floor((F.col(order) - lo) * parts / (hi - lo + 1)), F.lit(parts - 1))
    runs = []
    for i in range(parts):
        df.where(number == i).write.mode("append").parquet(path)
        runs.append(lv.run_available(build(t.spark.readStream.schema(df.schema).parquet(path)), folder))
    return runs


def _stream(t, df, order, parts=6):
    """``df`` as files of slices in ``order``, several a slice; a trigger reads about one slice."""
    path = scratch_dir(t.spark, "stream")
    df.repartitionByRange(4 * parts, order).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("l01_cue_source", "select seq, stream_id, source, text from live_cues")
def _(t):
    path = scratch_dir(t.spark, "cues")
    t.live_cues.select("stream_id", "listener_id", "seq", "source", "text", F.col("observed_at").cast("timestamp").alias("observed_at")).write.json(path)
    return lv.read_cues(t.spark, path, stream=False).select("seq", "stream_id", "source", "text")


NORM = r"trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))"


@query("l02_normalised_cues", f"select seq, {NORM} as text, cast(null as varchar) reason from live_cues")
def _(t):
    return lv.normalise(t.live_cues).select("seq", "text", "reason")


EMIT = """select stream_id, seq, text, case when text is null then 'clear' else 'cue' end event from (select *, lag(source || chr(1) || text) over (partition by stream_id order by seq) p, row_number() over (partition by stream_id order by seq) rn from live_cues)
  where (text is null and p is not null) or (text is not null and (p is null or p<>concat(source, chr(1), text)))"""


@query("l03_emitted_cues", EMIT)
def _(t):
    return lv.emitted(t.live_cues).select("stream_id", "seq", "text", "event")


@query("l03_emitted_cues_stream", EMIT)
def _(t):
    runs = _deliveries(t, _timed(t).select("stream_id", "seq", "source", "text", "observed_at"), "seq", "emit", lambda s: lv.emitted_stream(s, **AGES))
    return t.spark.read.parquet(runs[-1].out).select("stream_id", "seq", "text", "event")


@query("l04_clear_events", f"select stream_id, count(*) n_clears from ({EMIT}) where event='clear' group by all")
def _(t):
    return lv.emitted(t.live_cues).where("event = 'clear'").groupBy("stream_id").agg(F.count("*").alias("n_clears"))


PHV = f"""(select word, position, case position when 'onset' then substr('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ', cast((unicode(ch)-44032)//588+1 as int), 1) when 'nucleus' then substr('ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ', cast((unicode(ch)-44032)%588//28+1 as int), 1)
  else substr('-ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ', cast((unicode(ch)-44032)%28+1 as int), 1) end symbol
  from (select v, word, unnest(string_split(word,'')) ch from {REF}) cross join (values ('onset'),('nucleus'),('coda')) p(position))"""
def _risks_sql(phonemes: str) -> str:
    """Independence risk of each calibrated listener for each word of ``phonemes``."""
    return f"""(select d.listener_id, v.word, 1-exp(sum(ln(greatest(case when v.position='coda' and d.big_n=0 and v.symbol<>'-' and t.surface<>v.symbol and coalesce(s.big_n,0)>0 then s.p else d.p end,1e-6)))) risk
  from {phonemes} v join diag d on d.position=v.position and d.target=v.symbol{{pairs}} join dim_target t on t.position=v.position and t.symbol=v.symbol
  left join diag s on s.listener_id=d.listener_id and s.position='coda' and v.position='coda' and s.target=t.surface group by all)"""


REFRISK = _risks_sql(PHV).format(pairs="")
CUEPAIR = "(select distinct listener_id, unnest(string_split(text,' ')) word from live_cues where text is not null)"
CUEPHV = PHV.replace(f"select v, word, unnest(string_split(word,'')) ch from {REF}", f"select listener_id cue_listener, word, unnest(regexp_extract_all(word,'[가-힣]')) ch from {CUEPAIR}").replace("(select word, position", "(select cue_listener, word, position", 1)
CUERISK = _risks_sql(CUEPHV).format(pairs=" and d.listener_id=v.cue_listener")
TAU = f"(select r.listener_id, quantile_cont(r.risk,0.8) tau from {REFRISK} r join {REF} w on w.word=r.word group by all)"


def taus(t):
    return lv.listener_thresholds(qc.profiles(t).select("listener_id", "prof_nlog"))


@query("l05_listener_thresholds", f"select listener_id, round(tau,6) tau from {TAU}")
def _(t):
    return rnd(taus(t).select("listener_id", "tau"))


CUEW = f"""(select c.stream_id, c.seq, w.i, w.word, k.tau, len(regexp_extract_all(w.word,'[가-힣]'))>0 and x.risk is null lost,
  coalesce(len(regexp_extract_all(w.word,'[가-힣]'))>0 and x.risk>=k.tau, false) sel
  from (select * from live_cues where text is not null) c cross join lateral (select unnest(string_split(c.text,' ')) word, unnest(range(0,len(string_split(c.text,' ')))) i) w
  left join {TAU} k on k.listener_id=c.listener_id left join {CUERISK} x on x.listener_id=c.listener_id and x.word=w.word)"""
SCORED = f"""(select stream_id, seq, count(*) n_words, count(*) filter (where sel) n_selected, coalesce(string_agg(word,' ' order by i) filter (where sel),'') display_text,
  case when max(tau) is null then 'no_threshold' when bool_or(lost) then 'unscored_words' end reason from {CUEW} group by all)"""


def scored_cues(t):
    """All cues with a text, every Hangul word of theirs scored with its listener's estimates."""
    return lv.score_whole_cues(t.live_cues.where("text is not null"), taus(t), ["stream_id", "seq"])


@query("l06_scored_cues", f"select * from {SCORED}")
def _(t):
    return scored_cues(t)


STALE = "select stream_id, seq, coalesce(seq < max(seq) over (partition by stream_id order by arrival, seq rows between unbounded preceding and 1 preceding), false) stale from live_cues"


@query("l07_stale_results", STALE)
def _(t):
    return lv.stale(t.live_cues).select("stream_id", "seq", "stale")


@query("l07_stale_results_stream", STALE)
def _(t):
    runs = _deliveries(t, _timed(t).select("stream_id", "seq", "arrival", "observed_at"), "arrival", "stale", lambda s: lv.stale_stream(s, **AGES))
    return t.spark.read.parquet(runs[-1].out).select("stream_id", "seq", "stale")


@query("l08_routes", "select c.seq, case when s.n is null then 'unknown_listener' when s.n<10 then 'not_ready' else 'score' end route from live_cues c left join (select listener_id, count(*) n from calib_trials group by all) s on s.listener_id=c.listener_id")
def _(t):
    return lv.route(t.live_cues, cf.profile_stats(qc.scored(t), ["listener_id"])).select("seq", "route")


@query("l09_content_free_metrics", f"select stream_id, seq, length(display_text) n_chars, n_words, n_selected, reason from {SCORED}")
def _(t):
    return lv.content_free(scored_cues(t))


@query("l10_windowed_volume", "select date_trunc('hour', observed_at) \"start\", count(*) n_cues, count(text) n_shown from live_cues group by all")
def _(t):
    cues = t.live_cues.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return lv.windowed_volume(cues).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("l11_sessions", """select stream_id, min(observed_at) "start", count(*) n_cues from (select *, sum(fresh) over (partition by stream_id order by observed_at, seq rows unbounded preceding) s from (select *,
  case when observed_at - lag(observed_at) over (partition by stream_id order by observed_at, seq) < interval 30 minute then 0 else 1 end fresh from live_cues)) group by stream_id, s""")
def _(t):
    cues = t.live_cues.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return lv.sessions(cues).drop("end").withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- event-time streams: one cue of ten arrives 12 days late, two of ten 90 minutes late, and copies come later still

LATE = "2 hours"
DELAY = "cast(concat('0x',substr(md5(concat('dl:',seq::varchar)),1,8)) as bigint)%10"
ARRIVED = f"(select *, observed_at + case when {DELAY}=0 then interval 12 day when {DELAY}<3 then interval 90 minute else interval 0 minute end arrived from live_cues)"
COPIES = f"(select stream_id, seq, text, observed_at, arrived + c.later arrived from {ARRIVED} cross join (values (interval 0 minute),(interval 30 minute),(interval 8 day)) c(later))"


def delivered(src):
    """SQL: number of each row's delivery ``k`` and the watermark ``wm`` that stands when it is read."""
    return f"""(select d.*, w.wm from (select *, (epoch_us(arrived)-min(epoch_us(arrived)) over ())//({DAYS}*86400000000) k from {src}) d left join
      (select k, date_trunc('millisecond', max(m) over (order by k rows between unbounded preceding and 1 preceding)) - interval {LATE} wm
       from (select k, max(observed_at) m from (select observed_at, (epoch_us(arrived)-min(epoch_us(arrived)) over ())//({DAYS}*86400000000) k from {src}) group by k)) w on w.k=d.k)"""


END = f"(select date_trunc('millisecond', max(observed_at)) - interval {LATE} e from live_cues)"


def _arrived(t, copies=("0 minutes",)):
    """Cues with ``arrived`` (microseconds), once for each delay in ``copies``."""
    tenth = hash32(F.concat(F.lit("dl:"), F.col("seq"))) % 10
    late = F.when(tenth == 0, 12 * 1440).when(tenth < 3, 90).otherwise(0)
    again = F.array(*[F.lit(lv.span_ms(c) * 1000) for c in copies])
    cues = _timed(t)
    return cues.select("stream_id", "seq", "text", "observed_at", (F.unix_micros("observed_at") + late.cast("long") * 60_000_000).alias("_at"), F.explode(again).alias("_more")).select(
        "stream_id", "seq", "text", "observed_at", (F.col("_at") + F.col("_more")).alias("arrived"))


def _by_arrival(t, df, name, build):
    """Run the stream after each delivery of ``DAYS`` days."""
    lo, hi = df.agg(F.min("arrived"), F.max("arrived")).first()
    span = DAYS * 86_400_000_000
    path, folder, runs = scratch_dir(t.spark, name), scratch_dir(t.spark, name), []
    for k in range((hi - lo) // span + 1):
        df.where(F.floor((F.col("arrived") - lo) / span) == k).drop("arrived").write.mode("append").parquet(path)
        runs.append(lv.run_available(build(t.spark.readStream.schema(df.drop("arrived").schema).parquet(path)), folder))
    return runs


def _naive(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("l10_windowed_stream", f"""select at0 "start", count(*) n_cues, count(text) n_shown from (select *, date_trunc('hour', observed_at) at0 from {delivered(ARRIVED)})
  where wm is null or at0 + interval 1 hour > wm group by all having at0 + interval 1 hour <= (select e from {END})""")
def _(t):
    runs = _by_arrival(t, _arrived(t), "windows", lambda s: lv.windowed_volume(s, late=LATE))
    return _naive(t.spark.read.parquet(runs[-1].out))


@query("l10_sliding_stream", f"""select at0 "start", count(*) n_cues, count(text) n_shown from (select *, make_timestamp((epoch_us(observed_at)//1800000000 - j)*1800000000) at0 from {delivered(ARRIVED)} cross join range(2) r(j))
  where wm is null or at0 + interval 1 hour > wm group by all having at0 + interval 1 hour <= (select e from {END})""")
def _(t):
    runs = _by_arrival(t, _arrived(t), "sliding", lambda s: lv.windowed_volume(s, slide="30 minutes", late=LATE))
    return _naive(t.spark.read.parquet(runs[-1].out))


@query("l11_sessions_stream", f"""select * from (select stream_id, min(observed_at) "start", count(*) n_cues from (select *, sum(fresh) over (partition by stream_id order by observed_at, seq rows unbounded preceding) s from (select *,
  case when observed_at - lag(observed_at) over (partition by stream_id order by observed_at, seq) < interval 30 minute then 0 else 1 end fresh from {delivered(ARRIVED)} where wm is null or observed_at + interval 30 minute > wm)) group by stream_id, s
  having max(observed_at) + interval 30 minute <= (select e from {END}))""")
def _(t):
    runs = _by_arrival(t, _arrived(t), "sessions", lambda s: lv.sessions(s, late=LATE))
    return _naive(lv.closed_sessions(t.spark, runs[-1]))


AGAIN = ("0 minutes", "30 minutes", "8 days")
ONTIME = f"(select * from {delivered(COPIES)} where wm is null or observed_at > wm)"


@query("l12_deduplicated_stream", f"select distinct stream_id, seq from {ONTIME}")
def _(t):
    runs = _by_arrival(t, _arrived(t, AGAIN).select("stream_id", "seq", "observed_at", "arrived"), "dedupe", lambda s: lv.deduplicated(s, LATE))
    return t.spark.read.parquet(runs[-1].out).select("stream_id", "seq")


@query("l12_late_rows", f"select (select count(*) from {COPIES}) n_delivered, (select count(*) from {COPIES})-(select count(*) from {ONTIME}) n_dropped_late, (select count(distinct seq) from {ONTIME}) n_kept")
def _(t):
    rows = _arrived(t, AGAIN).select("stream_id", "seq", "observed_at", "arrived")
    runs = _by_arrival(t, rows, "dedupe", lambda s: lv.deduplicated(s, LATE))
    kept = t.spark.read.parquet(runs[-1].out).agg(F.count("*").alias("n_kept"))
    return rows.agg(F.count("*").alias("n_delivered")).select("n_delivered", F.lit(sum(r.n_dropped_late for r in runs)).cast("long").alias("n_dropped_late")).join(kept)  # one row each


@query("l13_incremental_counts", "select * from counts")
def _(t):
    cols = t.calib_trials.select("trial_id", "listener_id", "target", "response")
    out = lv.run_batches(_stream(t, cols, "trial_id"), lv.count_batch, scratch_dir(t.spark, "counts"))
    return cf.pool(t.spark.read.parquet(out), ["listener_id"])


