"""Hearing-profile derivation (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonrisk.operators import hearing as hr
from phonrisk.suite.registry import query, r6

EAR = ["listener_id", "ear"]


def summary(t):
    return hr.listener_summary(t.audiogram_points, t.speech_scores, t.pi_points, t.loudness)


def _pta_sql(col):
    return " union all ".join(
        f"select listener_id, ear, '{m}' as method, round(({'+'.join(f't{h}' for h in hz)})/{len(hz)},6) pta, "
        f"len(list_filter([{','.join(f't{h}' for h in hz)}], lambda x: x is null)) n_missing from thr" for m, hz in hr.PTA_METHODS.items()) if col else ""


@query("e01_pta", _pta_sql(True))
def _(t):
    return hr.pta_by_method(hr.ears(t.audiogram_points)).select(
        *EAR, "method", r6("pta").alias("pta"), F.size("missing").alias("n_missing"))


@query("e02_pta_provenance", " union all ".join(
    f"select listener_id, ear, '{m}' as method, '{','.join(map(str, hz))}' required, array_to_string(list_filter([{','.join(f'case when t{h} is null then {h} end' for h in hz)}], lambda x: x is not null), ',') missing from thr"
    for m, hz in hr.PTA_METHODS.items()))
def _(t):
    return hr.pta_by_method(hr.ears(t.audiogram_points)).select(
        *EAR, "method", F.array_join("required", ",").alias("required"), F.array_join("missing", ",").alias("missing"))


@query("e03_slope", "select listener_id, ear, round((t4000-t500)/3.0,6) slope from thr")
def _(t):
    return hr.ears(t.audiogram_points).select(*EAR, r6(hr.slope()).alias("slope"))


@query("e04_severity", "select listener_id, severity_who, severity_4group from hear")
def _(t):
    return summary(t).select("listener_id", "severity_who", "severity_4group")


@query("e05_pbmax", "select listener_id, ear, pbmax, pbmax_level from ear_pi")
def _(t):
    return hr.pi_function(t.pi_points).select(*EAR, "pbmax", "pbmax_level")


@query("e06_rollover", "select listener_id, ear, round(rollover_index,6) rollover_index from ear_pi")
def _(t):
    return hr.pi_function(t.pi_points).select(*EAR, r6("rollover_index").alias("rollover_index"))


@query("e07_dynamic_range", "select listener_id, ear, ucl_db_hl-mcl_db_hl dynamic_range_db from loudness")
def _(t):
    return t.loudness.select(*EAR, hr.dynamic_range().alias("dynamic_range_db"))


@query("e08_better_worse_ear", "select listener_id, round(better_ear_pta,6) better_ear_pta, round(worse_ear_pta,6) worse_ear_pta from hear")
def _(t):
    return summary(t).select("listener_id", r6("better_ear_pta").alias("better_ear_pta"), r6("worse_ear_pta").alias("worse_ear_pta"))


@query("e09_best_speech", "select listener_id, wrs, srt, pbmax, mcl from hear")
def _(t):
    return summary(t).select("listener_id", "wrs", "srt", "pbmax", "mcl")


MISSING = "list_filter([" + ",".join(f"case when {f} is null then '{f}' end" for f in hr.CLINICAL_FIELDS) + "], lambda x: x is not null)"


@query("e10_completeness", f"select listener_id, array_to_string({MISSING},',') missing, round(1-len({MISSING})/7.0::double,6) completeness from hear")
def _(t):
    return summary(t).select("listener_id", F.array_join("missing", ",").alias("missing"), r6("completeness").alias("completeness"))


@query("e11_profile_summary", """select listener_id, round(pta_left,6) pta_left, round(pta_right,6) pta_right, round(better_ear_pta,6) better_ear_pta, severity_who,
  srt, wrs, pbmax, mcl, round(high_freq_mean,6) high_freq_mean, round(audiogram_slope,6) audiogram_slope from hear""")
def _(t):
    r = lambda c: r6(c).alias(c)
    return summary(t).select("listener_id", r("pta_left"), r("pta_right"), r("better_ear_pta"), "severity_who", "srt", "wrs", "pbmax", "mcl",
                             r("high_freq_mean"), r("audiogram_slope"))


@query("e12_profile_rules", """select listener_id, ear, 'no_response_needs_level' as rule from audiogram_points where no_response and db_hl is null
  union all select listener_id, ear, 'db_range' from audiogram_points where db_hl<-10 or db_hl>130
  union all select listener_id, ear, 'standard_hz' from audiogram_points where hz not in (125,250,500,1000,2000,3000,4000,6000,8000)
  union all select listener_id, ear, 'db_range' from speech_scores where srt_db_hl<-10 or srt_db_hl>130 or wrs_level_db_hl<-10 or wrs_level_db_hl>130
  union all select listener_id, ear, 'wrs_needs_level' from speech_scores where wrs_percent is not null and wrs_level_db_hl is null
  union all select listener_id, ear, 'percent_range' from speech_scores where wrs_percent<0 or wrs_percent>100
  union all select listener_id, ear, 'percent_range' from pi_points where score_percent<0 or score_percent>100
  union all select distinct listener_id, ear, 'duplicate_level' from (select listener_id, ear, level_db_hl from pi_points group by all having count(*)>1)
  union all select listener_id, ear, 'ucl_below_mcl' from loudness where ucl_db_hl<mcl_db_hl
  union all select listener_id, null, 'source_synthetic' from hearing_meta where (source='synthetic')<>is_synthetic
  union all select listener_id, ear, 'ear_without_audiogram' from (select listener_id, ear from speech_scores union select listener_id, ear from pi_points union select listener_id, ear from loudness)
    where (listener_id, ear) not in (select listener_id, ear from audiogram_points)
  union all select listener_id, null, 'no_ear' from hearing_meta where listener_id not in (select listener_id from audiogram_points union select listener_id from speech_scores union select listener_id from pi_points union select listener_id from loudness)""")
def _(t):
    return hr.violations(t.audiogram_points, t.speech_scores, t.pi_points, t.loudness, t.hearing_meta)
