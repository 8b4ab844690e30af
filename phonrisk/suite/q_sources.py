"""Sources and sinks (S), validation (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonrisk.operators import quality as ql
from phonrisk.operators import features as ft
from phonrisk.operators import stimuli
from phonrisk.session import durable, scratch_dir
from phonrisk.sources import manifest as mf
from phonrisk.sources import tables as tb
from phonrisk.suite import q_confusion as qc
from phonrisk.suite import q_features as qf
from phonrisk.suite.q_features import rnd
from phonrisk.suite.q_text import DUCK_DESIGN
from phonrisk.suite.registry import query


@query("s01_utterance_scan", "select utt_id, speaker_id, reference from utterances order by utt_id limit 100")
def _(t):
    path = scratch_dir(t.spark, "utterances")
    t.utterances.write.parquet(path)
    return tb.read_utterances(t.spark, path, limit=100)


@query("s01_utterance_positions", "select utt_id, reference from utterances where utt_id in (select conv_id*1000 from conversations)")
def _(t):
    path = scratch_dir(t.spark, "utterances")
    t.utterances.write.parquet(path)
    wanted = t.conversations.select((F.col("conv_id") * 1000).alias("utt_id"))
    return tb.read_utterances(t.spark, path, columns=("utt_id", "reference"), positions=wanted)


STIM = """concat('  ', case when o_orderkey % 2 = 0 then '남자' else '여자' end, case when o_orderkey % 101 = 0 then ' ' else '_' end, target)"""


@query("s02_stimulus_csv", """select concat('kmsp-', c.trial_id::varchar) stimulus_id, c.target syllable, case when c.trial_id%2=0 then 'male' else 'female' end speaker,
  case when c.trial_id%7=0 then null else round(c.trial_id::double/8,6) end duration_s from calib_trials c where c.trial_id%101<>0""")
def _(t):
    path = scratch_dir(t.spark, "stimuli")
    src = t.calib_trials.withColumn("o_orderkey", F.col("trial_id"))
    cols = {"Audio Sample ID ": F.col("trial_id").cast("string"), " file_name": F.lit("a.wav"), "Speaker Gender_Pronounced Answer": F.expr(STIM),
            " Syllable": F.lit(""), "Total Duration": F.when(F.col("trial_id") % 7 == 0, "n/a").otherwise((F.col("trial_id") / 8).cast("string")),
            "Mean Pitch": F.lit("1"), "F1": F.lit(""), "F2 (Hz)": F.lit("2"), "F3 (Hz)": F.lit("x")}
    src.select(*[c.alias(n) for n, c in cols.items()]).write.csv(path, header=True)
    good, _bad = tb.read_stimuli(t.spark, path)
    return rnd(good.select("stimulus_id", "syllable", "speaker", "duration_s"))


@query("s03_response_log", "select trial_id, listener_id, target, response from calib_trials")
def _(t):
    path = scratch_dir(t.spark, "responses")
    for part in ("quiet", "noise"):
        tb.append_responses(t.calib_trials.where(F.col("condition") == part).select("trial_id", "listener_id", "stimulus_id", "target", "response", "condition"), path)
    return tb.read_responses(t.spark, path).select("trial_id", "listener_id", "target", "response")


@query("s04_nested_profiles", "select listener_id, ear, hz, db_hl, no_response, masked from audiogram_points")
def _(t):
    path = scratch_dir(t.spark, "profiles")
    tb.nest_profiles(t.audiogram_points, t.hearing_meta).write.json(path)
    return tb.flatten_profiles(tb.read_profiles(t.spark, path))


@query("s05_transcript_scan", "select media_id, 'live-asr' backend, 'store' replayed_from, max(end_s) over (partition by media_id) duration_s, tok_idx, text, start_s, end_s, confidence from tokens")
def _(t):
    path = scratch_dir(t.spark, "transcripts")
    tb.pack_transcripts(t.tokens, "live-asr").write.json(path)
    return tb.read_transcripts(t.spark, path, "store")


@query("s06_media_mismatch", "select distinct user_id media_id from events where user_id not in (select media_id from tokens)")
def _(t):
    return tb.media_mismatches(t.events.select(F.col("user_id").alias("media_id")).distinct(), t.tokens)


@query("s07_transcript_sink", "select media_id, tok_idx//10 part, count(*) n_tokens, string_agg(text, ' ' order by tok_idx) line from tokens group by all")
def _(t):
    path = scratch_dir(t.spark, "transcripts")
    tb.pack_transcripts(t.tokens, "live-asr", 10).write.json(path)
    raw = t.spark.read.schema(tb.TRANSCRIPT_SCHEMA).json(path)
    return raw.select("media_id", "part", F.size("tokens").alias("n_tokens"), F.array_join(F.transform("tokens", lambda x: x["text"]), " ").alias("line"))


@query("s08_file_manifest")
def _(t):
    path = scratch_dir(t.spark, "files")
    t.documents.select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    return mf.build(t.spark, path, "documents")


@query("s09_content_digest", """select source_id, sha256(string_agg(concat(h, chr(10)), '' order by c)) digest from (
  select source_id, c, sha256(string_agg(concat(path, chr(0), sha256, chr(10)), '' order by rn)) h from (
    select source_id, path, sha256, rn, (rn-1)//10000 c from (select *, row_number() over (partition by source_id order by path collate "binary") rn from files_recorded)) group by all) group by all""")
def _(t):
    return mf.content_digest(t.files_recorded, ["source_id"])


VERIFY = """select coalesce(a.path,b.path) path, case when b.path is null then 'missing' when a.path is null then 'unrecorded' when a.bytes<>b.bytes then 'size_mismatch' when a.sha256<>b.sha256 then 'checksum_mismatch' else 'match' end state
  from files_recorded a full join files_present b on a.path=b.path"""


@query("s10_manifest_verify", VERIFY)
def _(t):
    return mf.verify(t.files_recorded, t.files_present)


@query("s11_verified_sources", f"select r.source_id, count(*) filter (where v.state<>'match') n_problems from ({VERIFY}) v join files_recorded r on r.path=v.path group by all")
def _(t):
    v = mf.verify(t.files_recorded, t.files_present)
    return t.files_recorded.select("source_id", "path").join(v, "path").groupBy("source_id").agg(F.count_if(F.col("state") != "match").alias("n_problems"))


@query("s11_verified_read", "select source, count(*) n, true changed_refused from documents group by all")
def _(t):
    path = scratch_dir(t.spark, "verified")
    t.documents.select("doc_id", "source", "n_chars").repartition("source").write.partitionBy("source").parquet(path)
    recorded = durable(mf.build(t.spark, path, "documents"))
    read = durable(mf.read_verified(t.spark, path, recorded).groupBy("source").agg(F.count("*").alias("n")))
    t.documents.select("doc_id", "source", "n_chars").limit(1).write.mode("append").partitionBy("source").parquet(path)
    try:
        mf.read_verified(t.spark, path, recorded)
        refused = False
    except ValueError:
        refused = True
    return read.withColumn("changed_refused", F.lit(refused))


@query("s12_expectations", "select source_id, count(*) n_seen, count(*)=(count(*)//2)*2 count_ok, sum(bytes)>=1000 bytes_ok from files_recorded group by all")
def _(t):
    want = t.files_recorded.groupBy("source_id").agg((F.floor(F.count("*") / 2) * 2).alias("n_files")).withColumn("min_bytes", F.lit(1000))
    return mf.expectations(t.files_recorded, want)


@query("s13_artifact_states", """select a.path, case when b.path is null then 'missing' when a.s is null then 'not_recorded' when a.s=b.sha256 then 'match' else 'modified' end state
  from (select path, case when bytes%5=0 then null else sha256 end s from files_recorded) a left join files_present b on a.path=b.path""")
def _(t):
    rec = t.files_recorded.withColumn("sha256", F.when(F.col("bytes") % 5 != 0, F.col("sha256")))
    return mf.artifact_states(rec, t.files_present)


@query("s14_run_artifacts", "select concat('seed-', seed::varchar) run_id, count(*) n from word_trials group by all")
def _(t):
    path = scratch_dir(t.spark, "runs")
    tb.write_runs(t.word_trials.select(F.concat(F.lit("seed-"), F.col("seed").cast("string")).alias("run_id"), "row_id", "score"), path)
    return t.spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


@query("s15_csv_report", "select seed::varchar seed, round(avg(score),6)::varchar mean_score from word_trials group by all")
def _(t):
    path = scratch_dir(t.spark, "report")
    tb.write_report(rnd(t.word_trials.groupBy("seed").agg(F.avg("score").alias("mean_score"))), path)
    return t.spark.read.schema("seed string, mean_score string").csv(path, header=True)


@query("s16_subject_export", "select 'calib_trials' as \"table\", count(*) n from calib_trials where listener_id=7 union all select 'word_trials', count(*) from word_trials where listener_id=7 union all select 'speech_scores', count(*) from speech_scores where listener_id=7")
def _(t):
    rows = tb.export_listener({"calib_trials": t.calib_trials, "word_trials": t.word_trials, "speech_scores": t.speech_scores}, 7)
    return rows.groupBy("table").agg(F.count("row").alias("n"))


GONE = "(select distinct s_nationkey from supplier where s_nationkey in (select listener_id from calib_trials))"


@query("s17_subject_erasure", " union all ".join(f"select '{n}' as \"table\", count(*) filter (where listener_id in {GONE}) n_removed, count(*) filter (where listener_id not in {GONE}) n_left, 0::bigint n_found, true unknown_refused from {n}" for n in ("calib_trials", "word_trials")))
def _(t):
    gone = t.supplier.select(F.col("s_nationkey").cast("bigint").alias("listener_id")).distinct().join(t.calib_trials.select("listener_id").distinct(), "listener_id", "left_semi")
    root, names = scratch_dir(t.spark, "subjects"), ["calib_trials", "word_trials"]
    tb.store_by_listener({n: getattr(t, n) for n in names}, root)
    try:
        tb.erase_stored(t.spark, root, names, gone.unionByName(t.spark.createDataFrame([(-1,)], "listener_id bigint")))
        refused = False
    except KeyError:
        refused = True
    report = tb.erase_stored(t.spark, root, names, gone)
    found = [t.spark.read.parquet(f"{root}/{n}").join(gone, "listener_id", "left_semi").agg(F.count("*").alias("n_found")).select(F.lit(n).alias("table"), "n_found") for n in names]
    return report.join(found[0].unionByName(found[1]), "table").withColumn("unknown_refused", F.lit(refused))


@query("s18_listener_ids", "select distinct listener_id from calib_trials")
def _(t):
    return tb.listener_ids(t.calib_trials)


@query("s19_srt_files", None)
def _(t):
    from phonrisk.operators import cues as cu
    from phonrisk.sources.caption_files import write_files
    from phonrisk.suite.q_policy import shown
    path = scratch_dir(t.spark, "srt")
    write_files(cu.srt_blocks(cu.build_cues(shown(t))), path, "srt", media="media_id", order="cue_idx", text="block")
    lines = F.split(F.decode("content", "UTF-8"), "\n")
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.srt").load(path)
    return files.select(F.regexp_extract("path", r"/(\d+)\.srt$", 1).cast("long").alias("media_id"),
                        F.size(F.filter(lines, lambda x: x.contains("-->"))).cast("long").alias("n_cues"))


@query("s20_consumed_digests", "select source_id, count(*) n from files_recorded where source_id in (select source from documents where lang='en') group by all")
def _(t):
    used = t.documents.where("lang = 'en'").select(F.col("source").alias("source_id"))
    return mf.consumed(t.files_recorded, used).groupBy("source_id").agg(F.count("*").alias("n"))


def _reasons(pairs):
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in pairs) + "], lambda x: x is not null), ',')"


def _joined(df, *keep):
    return df.select(*keep, F.array_join("reasons", ",").alias("reasons"))


TOK = [("bad_time", "start_s is null or end_s is null"), ("negative_start", "start_s<0"), ("ends_before_start", "end_s<start_s"), ("bad_confidence", "confidence<0 or confidence>1")]


@query("v01_token_rules", f"select row_id, {_reasons(TOK)} reasons from dirty_tokens")
def _(t):
    return _joined(ql.with_reasons(t.dirty_tokens, ql.token_rules()), "row_id")


@query("v02_transcript_rules", f"select media_id, {_reasons([('bad_duration', 'd is null or d<0'), ('bad_language_probability', 'p<0 or p>1')])} reasons from (select media_id, max(end_s)-40 d, max(confidence) p from dirty_tokens group by all)")
def _(t):
    tr = t.dirty_tokens.groupBy("media_id").agg((F.max("end_s") - 40).alias("duration_s"), F.max("confidence").alias("language_probability"))
    return _joined(ql.with_reasons(tr, ql.transcript_rules()), "media_id")


@query("v03_word_risk_rules", f"select row_id, {_reasons([('bad_risk', 'listener_risk is null or listener_risk<0 or listener_risk>1'), ('bad_confidence', 'confidence<0 or confidence>1')])} reasons from dirty_tokens")
def _(t):
    return _joined(ql.with_reasons(t.dirty_tokens, ql.risk_rules()), "row_id")


@query("v03_quarantine_split", "select count(*) filter (where ok) n_good, count(*) filter (where not ok) n_quarantined from (select not (listener_risk is null or listener_risk<0 or listener_risk>1 or coalesce(confidence<0 or confidence>1,false)) ok from dirty_tokens)")
def _(t):
    good, bad = ql.split(ql.with_reasons(t.dirty_tokens, ql.risk_rules()))
    return good.agg(F.count("*").alias("n_good")).join(F.broadcast(bad.agg(F.count("*").alias("n_quarantined"))))  # one row


@query("v04_metric_inputs", "select count(*) n_rows, count(*) filter (where label not in (0,1)) n_bad_label, count(*) filter (where listener_risk is null) n_not_finite, count(*) filter (where listener_risk<0 or listener_risk>1) n_out_of_range from dirty_tokens")
def _(t):
    from phonrisk.operators.metrics import bad_inputs
    return bad_inputs(t.dirty_tokens, "label", "listener_risk")


NORM = r"trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))"


@query("v05_cue_rules", f"select conv_id, turn, case when c='' then 'empty' when length(c)>500 then 'too_long' when len(string_split(c,' '))>60 then 'too_many_tokens' end reason from (select conv_id, turn, {NORM} c from conversations)")
def _(t):
    from phonrisk.streaming.live import normalise
    return normalise(t.conversations).select("conv_id", "turn", "reason")


@query("v06_cue_shape", "select seq, case when seq%17=0 then 'malformed' when seq%13=0 then 'no_source' when seq%11=0 then 'no_time' when seq%7=0 and text is not null then 'not_normalised' end reason from live_cues")
def _(t):
    from phonrisk.streaming.live import read_cues, shape_reason
    path = scratch_dir(t.spark, "cues")
    s = F.col("seq")
    text = F.when(s % 7 == 0, F.concat(F.lit("  "), "text")).otherwise(F.col("text"))
    body = F.to_json(F.struct("stream_id", "listener_id", "seq", F.when(s % 13 != 0, F.col("source")).alias("source"), text.alias("text"),
                              F.when(s % 11 != 0, F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("observed_at")))
    line = F.when(s % 17 == 0, F.concat(F.lit('{"seq": '), s.cast("string"), F.lit(', "stream_id": '))).otherwise(body)
    t.live_cues.select(line.alias("value")).write.text(path)
    rows = read_cues(t.spark, path, stream=False)
    seq = F.coalesce("seq", F.regexp_extract("_corrupt_record", r'"seq": (\d+)', 1).cast("long"))
    return rows.select(seq.alias("seq"), shape_reason().alias("reason"))


@query("v07_identity", f"""select r.listener_id, {_reasons([('hearing_of_other_listener', 'h.owner_id<>r.listener_id'), ('confusion_of_other_listener', 'c.owner_id<>r.listener_id'), ('provenance_mismatch', 'h.is_synthetic<>c.is_synthetic')])} reasons
  from (select distinct listener_id from word_trials) r left join stored_profiles h on h.listener_id=r.listener_id left join (select listener_id, owner_id, listener_id%2=0 is_synthetic from stored_profiles) c on c.listener_id=r.listener_id""")
def _(t):
    conf = t.stored_profiles.withColumn("is_synthetic", F.col("listener_id") % 2 == 0)
    return _joined(ql.identity_problems(t.word_trials.select("listener_id").distinct(), t.stored_profiles, conf), "listener_id")


@query("v08_readiness", f"""select r.listener_id, {_reasons([('no_hearing_profile', 'h.listener_id is null'), ('no_confusion_profile', 'c.n_trials is null'), ('too_few_trials', 'c.n_trials<10')])} reasons
  from (select distinct listener_id from word_trials) r left join (select * from stored_profiles where present) h on h.listener_id=r.listener_id left join (select listener_id, n_trials from stored_profiles where n_trials<>0) c on c.listener_id=r.listener_id""")
def _(t):
    p = t.stored_profiles
    return _joined(ql.readiness(t.word_trials.select("listener_id").distinct(), p.where("present"), p.where("n_trials <> 0"), "clinical_plus_confusion"), "listener_id")


@query("v09_submission_check", f"""select t.trial_id, {_reasons([('unknown_stimulus', 'c.i is null'), ('wrong_target', 'c.syllable<>t.target')])} reasons from (select *, stimulus_id + case when trial_id%9=0 then 3000 else 0 end + case when trial_id%5=0 then 1 else 0 end sid from calib_trials) t
  left join (select range i, {DUCK_DESIGN.replace('i%', 'range%')} syllable from range(3192)) c on c.i=t.sid""")
def _(t):
    cat = stimuli.balanced_catalog(t.spark).select(F.col("pos").alias("stimulus_id"), "syllable")
    shift = F.when(F.col("trial_id") % 9 == 0, 3000).otherwise(0) + F.when(F.col("trial_id") % 5 == 0, 1).otherwise(0)
    return _joined(ql.submission_problems(t.calib_trials.withColumn("stimulus_id", F.col("stimulus_id") + shift), cat), "trial_id")


def _matrix_counts(t, arm):
    m = qf.matrix(t, arm)
    ql.check_matrix(m, arm)
    return m


@query("v10_live_contract")
def _(t):
    out = None
    for arm in ("live_word_context_clinical_confusion", "clinical_plus_confusion"):
        m = qf.matrix(t, arm)
        row = m.agg(F.count("*").alias("n_rows")).select(F.lit(arm).alias("arm"), "n_rows", F.lit(",".join(ql.column_violations(m.columns))).alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


LIVE_NAMES = "".join(f"{c}\n" for c in ft.arm_columns("live_word_context_clinical_confusion")).replace("\n", "'||chr(10)||'")


@query("v11_schema_hash", f"select count(*) n_rows, sha256('live-caption-v1'||chr(0)||'{LIVE_NAMES}') schema_hash from word_trials where listener_id in (select listener_id from cal_listeners)")
def _(t):
    m = _matrix_counts(t, "live_word_context_clinical_confusion")
    names = [c for c in m.columns if c not in ("row_id", "listener_id", "misheard")]
    return m.agg(F.count("*").alias("n_rows")).withColumn("schema_hash", F.lit(ql.schema_hash(names)))


@query("v12_stored_alphabets", """select d.listener_id, d.position, d.t_idx idx, case when d.t_idx=3 and d.listener_id%10=1 then 'q' else d.target end label, 'mismatch' reason from diag d where d.t_idx=3 and d.listener_id%10=1
  union all select listener_id, position, t_idx, null, 'absent' from diag where t_idx=5 and listener_id%10=2""")
def _(t):
    rows = qc.rows(t).select("listener_id", "position", F.col("t_idx").alias("idx"), F.col("target").alias("label"))
    bad = rows.withColumn("label", F.when((F.col("idx") == 3) & (F.col("listener_id") % 10 == 1), "q").otherwise(F.col("label")))
    return ql.label_problems(bad.where(~((F.col("idx") == 5) & (F.col("listener_id") % 10 == 2))), ["listener_id"])


@query("v13_mixed_provenance", "select source, count(distinct is_synthetic) n_kinds, count(*) n_profiles from hearing_meta group by all having count(distinct is_synthetic)>1")
def _(t):
    return ql.mixed_provenance(t.hearing_meta, ["source"])


@query("v14_family_availability")
def _(t):
    m = qf.matrix(t, "clinical_plus_confusion")
    n = m.agg(F.count("*").alias("n_rows"), F.count("x_r_phon").alias("n_scored"))
    return ql.availability(t.spark).join(F.broadcast(n))  # one row


@query("v15_column_set", "select count(*) n_rows, 50 n_features from word_trials where listener_id in (select listener_id from cal_listeners)")
def _(t):
    m = _matrix_counts(t, "clinical_plus_confusion")
    return m.agg(F.count("*").alias("n_rows")).withColumn("n_features", F.lit(len(m.columns) - 3))
