"""Subtitle cues from captioned words, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonrisk.functions.text import ass_escape, ass_stamp, risk_colour, srt_stamp
from phonrisk.operators.ordered import is_bounded, rank_rows, running, with_lag

# Merge gap, words per cue, minimum duration (seconds).
MERGE_GAP_S, MAX_WORDS, MIN_DURATION_S = 0.35, 8, 0.4

# Fixed value: the script header players expect.
ASS_HEADER = """[Script Info]
Title: selective captions
ScriptType: v4.00+
WrapStyle: 0
ScaledBorderAndShadow: yes
PlayResX: 1920
PlayResY: 1080

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Noto Sans CJK KR,64,&H00FFFFFF,&H000000FF,&H00000000,&HA0000000,0,0,0,0,100,100,0,0,3,3,1,2,80,80,60,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"""


def build_cues(shown: DataFrame, media: str = "media_id", *, merge_gap: float = MERGE_GAP_S, max_words: int = MAX_WORDS,
               min_duration: float = MIN_DURATION_S, risk: str = "listener_risk", bounded: bool | None = None) -> DataFrame:
    """Group shown words in time order: a cue ends at a gap or at ``max_words``."""
    fits = is_bounded(shown, [media]) if bounded is None else bounded
    ranked = rank_rows(shown, [media], ["start_s", "end_s", "tok_idx"], rn="_rn", bounded=fits)
    prev = with_lag(ranked, [media], ["_rn"], {"_prev_end": "end_s"}, bounded=fits)
    fresh = F.coalesce(F.col("start_s") - F.col("_prev_end") > merge_gap, F.lit(True))
    flagged = prev.withColumn("_new", fresh.cast("int")).withColumn("_at", F.when(fresh, F.col("_rn")))
    runs = running(flagged, [media], ["_rn"], {"_run": "_new"}, {"_first": "_at"}, bounded=fits)
    chunk = F.floor((F.col("_rn") - F.col("_first")) / max_words)
    words = F.array_sort(F.collect_list(F.struct("_rn", "text", F.col(risk).alias("risk"))))  # at most max_words
    cues = runs.groupBy(media, "_run", chunk.alias("_chunk")).agg(
        F.min("_rn").alias("_start_rn"), F.min_by("start_s", "_rn").alias("start_s"), F.max_by("end_s", "_rn").alias("_end"),
        F.max(risk).alias("max_risk"), words.alias("words"))
    cues = cues.withColumn("end_s", F.greatest(F.col("_end"), F.col("start_s") + min_duration))
    numbered = rank_rows(cues, [media], ["_start_rn"], rn="cue_idx", bounded=fits)
    follow = with_lag(numbered, [media], ["cue_idx"], {"_next": "start_s"}, lead=True, bounded=fits)
    trimmed = F.when(F.col("end_s") > F.col("_next"), F.greatest(F.col("start_s"), F.col("_next") - 0.001)).otherwise(F.col("end_s"))
    return follow.select(media, "cue_idx", "start_s", trimmed.alias("end_s"), "max_risk", F.transform("words", lambda w: F.struct(
        w["text"].alias("text"), w["risk"].alias("risk"))).alias("words"))


def bad_cues(cues: DataFrame, media: str = "media_id", *, bounded: bool | None = None) -> DataFrame:
    """Cues with no duration or overlapping their predecessor."""
    prev = with_lag(cues, [media], ["cue_idx"], {"_prev_end": "end_s"}, bounded=bounded)
    why = F.when(F.col("end_s") <= F.col("start_s"), "no_duration").when(F.col("start_s") < F.col("_prev_end"), "overlap")
    return prev.withColumn("reason", why).where("reason is not null").drop("_prev_end")


def cue_line(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def srt_blocks(cues: DataFrame) -> DataFrame:
    """One SubRip block per cue; a media's file is its blocks in ``cue_idx`` order."""
    text = F.concat(F.col("cue_idx").cast("string"), F.lit("\n"), srt_stamp(F.col("start_s")), F.lit(" --> "), srt_stamp(F.col("end_s")),
                    F.lit("\n"), cue_line(F.col("words")), F.lit("\n\n"))
    return cues.withColumn("block", text)


def ass_lines(cues: DataFrame) -> DataFrame:
    """One Dialogue line per cue with per-word risk colour, to follow ``ASS_HEADER``."""
    coloured = F.array_join(F.transform("words", lambda w: F.concat(
        F.lit("{\\c"), risk_colour(w["risk"]), F.lit("}"), ass_escape(w["text"]))), " ")
    line = F.concat(F.lit("Dialogue: 0,"), ass_stamp(F.col("start_s")), F.lit(","), ass_stamp(F.col("end_s")), F.lit(",Default,,0,0,0,,"), coloured)
    return cues.withColumn("line", line)


def ass_file(cues: DataFrame, media: str = "media_id") -> DataFrame:
    """(media, line_no, line): each media's whole script, the header and then its cues in order."""
    header = F.array(*[F.lit(x) for x in ASS_HEADER.split("\n")])
    head = cues.select(media).distinct().select(media, F.posexplode(header).alias("_i", "line"))
    body = ass_lines(cues).select(media, (F.size(header) + F.col("cue_idx")).cast("bigint").alias("line_no"), "line")
    return head.select(media, (F.col("_i") + 1).cast("bigint").alias("line_no"), "line").unionByName(body)


def json_rows(words: DataFrame, summary: DataFrame, media: str = "media_id") -> DataFrame:
    """Research export as JSON lines: a header row per media, then every word, shown or hidden."""
    head = summary.select(media, F.lit(-1).cast("bigint").alias("tok_idx"), F.to_json(F.struct(
        F.lit("caption.v1").alias("schema"), "n_words", "n_shown", "caption_ratio",
        (1 - F.col("caption_ratio")).alias("caption_reduction_ratio"))).alias("json"))
    body = words.select(media, F.col("tok_idx").cast("bigint").alias("tok_idx"), F.to_json(F.struct(
        "text", "start_s", "end_s", "listener_risk", F.col("confidence").alias("asr_confidence"), "decision", "policy"),
        {"ignoreNullFields": "false"}).alias("json"))
    return head.unionByName(body)
